"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscope.session import ship, spread

#: Words of the contracts: runs of anything but space, \t, \n, \v, \f, \r.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, sf_dir: str) -> DataFrame:
    """The whole table of documents, over all cores even if it is one small file."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose texts together have about most_bytes (a single longer text is a part of its own)."""
    col = batch.column(column)
    size = [0] * len(col) if col.null_count == len(col) else [len(x.as_buffer()) if x.is_valid else 0 for x in col]
    start, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(size):
        yield batch.slice(start)


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """df.mapInArrow with a function of one batch."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield f(b)

    return df.mapInArrow(run, schema)


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id as long, and text with null as the empty string; all other columns are dropped."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names for columns of an operator's own, with as many underscores ahead as keep them apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Return to the system what this worker has freed: its next tasks may need less, and others share the machine."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
