"""Scalar functions that Spark has not, or has with other semantics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: what ends a line.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"

LINE_ENDS = ["\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def line_count(text: Column | str) -> Column:
    """Number of lines, as Python's str.splitlines counts them; '' has none."""
    c = F.col(text) if isinstance(text, str) else text
    open_end = (F.length(c) > 0) & ~F.right(c, F.lit(1)).isin(*LINE_ENDS)  # only the last character is looked at
    return (F.regexp_count(c, F.lit(LINE_END)) + F.when(open_end, 1).otherwise(0)).cast("long")


def _round(x: float | None, digits: int) -> float | None:
    return None if x is None or x != x else round(float(x), int(digits))


def py_round(x: Column, digits: int) -> Column:
    """Rounding of the exact binary value, half to even, as Python rounds. For a row or so of each project: it runs in Python."""

    @F.pandas_udf("double")
    def rounded(s: pd.Series) -> pd.Series:
        return s.map(lambda v: _round(v, digits))

    return rounded(x)


def register(spark: SparkSession) -> None:
    """py_round(x, n) and parse_python(content) for SQL."""
    from siltscope.operators.extract import ParsePython
    from siltscope.session import ship

    ship(spark)
    spark.udf.register("py_round", _round, "double")
    spark.udtf.register("parse_python", ParsePython)
