"""The driver's queries for the analysis operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscope.functions.scalars import line_count, py_round
from siltscope.operators import complexity as cx
from siltscope.operators import match, score
from siltscope.operators.extract import FUNCTION, parse_files
from siltscope.plans import generated
from siltscope.plans.analyzer import Analysis
from siltscope.session import cut, spread
from siltscope.sources.catalog import catalog, entries
from siltscope.sources.listing import files_from, in_complexity_scope, list_python_files

#: A small corpus of Python sources: project, ordinal, path, content.
CORPUS = [
    ("leak", 0, "a.py", "x = 1\n"),
    ("leak", 1, "b.py", "import fastapi\n"),
    ("leak", 2, "c.py", "y = 2\n"),
    ("graph", 0, "a.py", "x = 1\n"),
    ("graph", 1, "b.py", "import networkx\nfrom collections import deque, OrderedDict as od\n"),
    ("graph", 2, "pkg/c.py", "from . import x\nfrom .m import y\nfrom m import *\n"),
    ("py2", 0, "a.py", "import networkx\nprint \"dict\"\n"),
    ("py2", 1, "b.py", "y = offset(1)  # arbitrary\n"),
    ("algo", 0, "sort.py", "def s(xs: list):\n    return sorted(xs)\n\ndef two(xs: list):\n    for x in xs:\n        for y in xs:\n            if x == y:\n                return x\n"),
    ("algo", 1, "search.py", "def find(xs: list, t: int):\n    lo, hi = 0, len(xs)\n    while lo < hi:\n        mid = (lo + hi) // 2\n        if xs[mid] < t:\n            lo = mid + 1\n        else:\n            hi = mid\n    return lo\n"),
    ("algo", 2, "fib.py", "from functools import lru_cache\n\n@lru_cache(maxsize=None)\ndef fib(n: int):\n    return n if n < 2 else fib(n - 1) + fib(n - 2)\n\ndef slow(n):\n    return n if n < 2 else slow(n - 1) + slow(n - 2)\n"),
    ("algo", 3, ".tox/skip.py", "def f():\n    return [a for a in range(3) for b in range(3)]\n"),
    ("algo", 4, "comp.py", "def pairs(xs: list, ys: list):\n    a = list(xs)\n    return {x: [y for y in ys] for x in a}\n"),
    ("web", 0, "app.py", "import logging\nfrom fastapi import FastAPI, Depends\nlogger = logging.getLogger()\nclass Repository:\n    def get_by_id(self, i):\n        try:\n            return self.cache[i]\n        except KeyError:\n            raise\n"),
    ("web", 1, "test_app.py", "import pytest\n\ndef test_a(mock):\r\n    assert mock\r\n"),
    ("empty", 0, "__init__.py", ""),
]
#: Import names by file, for the queries on imports: project, ordinal, names.
IMPORTS = [
    ("p", 0, ["os"]), ("p", 1, ["networkx", "json"]), ("p", 2, []), ("p", 3, ["pyjwt", "collections.deque", "redis.client"]), ("p", 4, ["sys"]),
    ("q", 0, ["pytest", "unittest.mock"]), ("q", 1, []), ("q", 2, ["heapq"]), ("r", 0, ["re"]), ("r", 5, ["django.db.models", "graphlib"]), ("r", 9, []),
]
PATHS = ["a.py", "pkg/a.py", "build/a.py", "Build/a.py", "x/venv/y/a.py", ".tox/a.py", "x/.eggs/a.py", "a.pyi", ".py", "node_modules/a.py", "dist.py", "_p/.h/a.py", "b.PY", "env/b.py"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of one project for each source. Prose is not parsed: it has no imports and no functions."""
    d = spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text"))
    return d.select(F.col("source").alias("project"), F.col("doc_id").alias("ordinal"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lower("text").alias("text_lc"), line_count("text").alias("line_count"), F.lit("ok").alias("scan_status"), F.array().cast("array<string>").alias("imports"), F.array().cast(f"array<{FUNCTION}>").alias("functions"))


def corpus(spark: SparkSession) -> DataFrame:
    return files_from(spark.createDataFrame(CORPUS, "project string, ordinal long, path string, content string"))


def parsed_corpus(spark: SparkSession) -> DataFrame:
    return parse_files(corpus(spark))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword matches of documents and of the corpus."""
    small = corpus(spark).select("project", "ordinal", "path", F.lower("content").alias("text_lc"))
    both = text_files(spark, sf_dir).select("project", "ordinal", "path", "text_lc").unionByName(small)
    return match.keyword_matches(both, catalog(spark))


def keyword_matches(spark, sf_dir):
    return matches(spark, sf_dir).select("project", "ordinal", "path", "category", "pattern")


def files_of_patterns(spark, sf_dir):
    """Each pattern's files as rows: a list would grow with the project."""
    return match.ranked_files(matches(spark, sf_dir)).select("project", "category", "pattern", "position", "path")


def pattern_totals(spark, sf_dir):
    return match.pattern_totals(matches(spark, sf_dir), catalog(spark)).select("project", "category", "pattern", "first_ordinal", "n_files", "description")


def top3_files(spark, sf_dir):
    out = match.ranked_files(matches(spark, sf_dir), first=3)
    return out.groupBy("project", "category", "pattern").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda x: x["path"]), ",").alias("files"))


def pattern_counts(spark, sf_dir):
    return matches(spark, sf_dir).groupBy("project", "category").agg(F.countDistinct("pattern").alias("n_patterns"))


def import_files(spark: SparkSession) -> DataFrame:
    rows = [(p, o, f"{o}.py", names) for p, o, names in IMPORTS]
    return spark.createDataFrame(rows, "project string, ordinal long, path string, imports array<string>")


def imports_cumulative(spark, sf_dir):
    return match.import_matches(import_files(spark), catalog(spark)).select("project", "ordinal", "category", "pattern")


def imports_of_file(spark, sf_dir):
    return match.import_matches(import_files(spark), catalog(spark), "file").select("project", "ordinal", "category", "pattern")


def line_counts(spark, sf_dir):
    return text_files(spark, sf_dir).select("project", "ordinal", "line_count")


def page_line_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", line_count("html").alias("line_count"))


def project_sizes(spark, sf_dir):
    return score.project_sizes(text_files(spark, sf_dir))


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Sizes of all projects (which name the projects as well), and their patterns' weights."""
    files, patterns = text_files(spark, sf_dir), catalog(spark)
    return score.project_sizes(files), score.pattern_weights(match.keyword_matches(files, patterns), patterns)


def project_scores(spark, sf_dir):
    sizes, weights = _parts(spark, sf_dir)
    tenths = lambda c: F.round(F.col(c) * 10).cast("long").alias(f"{c}_tenths")
    return score.scored(sizes, sizes, weights).select("project", tenths("dsa_weight"), tenths("design_weight"), *[F.round(c, 6).alias(c) for c in ("dsa_score", "design_score", "complexity_bonus", "raw_rating")], "dsa_patterns_count", "design_patterns_count", "files_scanned", "total_lines")


def project_rating(spark, sf_dir):
    """The rating as reported, with Python's rounding."""
    sizes, weights = _parts(spark, sf_dir)
    sizes = cut(sizes, "sizes")  # read twice, small
    return score.rate(sizes, sizes, weights)


def score_grid(spark, sf_dir):
    """Score functions over weights made from orders: tenths of 0 to 51.1, and null."""
    o = table(spark, sf_dir, "orders")
    w = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise((F.col("o_orderkey") * 7) % 512 / 10)
    files, lines = F.col("o_custkey") % 40, (F.col("o_custkey") * 13) % 4000
    dsa, design, bonus = score.dsa_score(w), score.design_score(w), score.size_bonus(files, lines)
    raw = score.raw_rating(dsa, design, bonus)
    return o.select("o_orderkey", *[F.round(c, 6).alias(n) for c, n in ((dsa, "dsa_score"), (design, "design_score"), (bonus, "size_bonus"), (raw, "raw_rating"))], score.rating_label(F.round(raw, 6)).alias("label"), score.rating_color(F.round(raw, 6)).alias("color"))


FACTS_SQL = """
  SELECT l_orderkey, l_linenumber, greatest(l_orderkey % 7 - 3, 0) AS recursive_calls, l_partkey % 3 = 0 AS uses_memo, l_suppkey % 6 AS max_loop_depth,
    l_linenumber % 3 = 0 AS has_log_n, l_partkey % 5 = 0 AS has_sort,
    CASE l_orderkey % 5 WHEN 1 THEN 'O(n)' WHEN 2 THEN 'O(log n)' WHEN 3 THEN 'O(n log k)' END AS first_cost,
    CASE l_orderkey % 5 WHEN 1 THEN 'sum' WHEN 2 THEN 'heappush' WHEN 3 THEN 'nlargest' END AS first_op,
    CASE l_suppkey % 4 WHEN 1 THEN 'O(n^2)' WHEN 2 THEN 'O(n^3)' END AS first_power,
    l_linenumber % 2 = 0 AS has_linear, l_partkey % 3 AS n_typed, l_orderkey % 2 = 0 AS first_loop_exits
  FROM lineitem
"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function facts made from lineitem, so that both engines see the same ones."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("siltscope_lineitem")
    return spark.sql(FACTS_SQL.replace("FROM lineitem", "FROM siltscope_lineitem"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, c = facts(spark, sf_dir), F.col
    rules, recursive = cx.time_rules({k: c(k) for k in x.columns}), c("recursive_calls") > 0
    return x.select(
        "l_orderkey", "l_linenumber", cx.decide(rules, 1).alias("time_complexity"), cx.decide(rules, 2).alias("reason"), cx.space_class(recursive, c("first_power"), c("has_linear")).alias("space_complexity"),
        cx.confidence(recursive, c("uses_memo"), c("max_loop_depth"), c("n_typed")).alias("confidence"), cx.dominant_operation(c("recursive_calls"), c("max_loop_depth"), c("first_op")).alias("dominant_operation"),
        cx.recursion_type(c("recursive_calls")).alias("recursion_type"), cx.loop_depth_class(c("max_loop_depth")).alias("loop_depth_class"), F.lit("p").alias("project"), c("l_orderkey").alias("ordinal"), c("l_linenumber").alias("walk_idx"),
    )


def _of(*columns):
    return lambda spark, sf_dir: classes(spark, sf_dir).select("l_orderkey", "l_linenumber", *columns)


def high_top10(spark, sf_dir):
    return cx.first_high(classes(spark, sf_dir), 10).select("l_orderkey", "l_linenumber", "time_complexity")


def path_scope(spark, sf_dir):
    """The lister on a folder with files at PATHS, beside all of these."""
    with tempfile.TemporaryDirectory() as root:
        for p in PATHS:
            os.makedirs(os.path.dirname(os.path.join(root, p)), exist_ok=True)
            open(os.path.join(root, p), "w").close()
        found = set(list_python_files(root))
    return spark.createDataFrame([(p, p in found, p in found and in_complexity_scope(p)) for p in PATHS], "path string, in_scan boolean, in_complexity boolean")


def corpus_functions(spark, sf_dir):
    return cx.function_complexity(parsed_corpus(spark)).select("project", "ordinal", "path", "walk_idx", "name", "line", "time_complexity", "space_complexity", "confidence", F.array_join("reasoning", "; ").alias("reasoning"), "has_recursion", "recursion_type", "uses_memoization", "has_early_exit", "dominant_operation", F.size("loop_analysis").alias("n_loops"), F.size("variables").alias("n_variables"))


def corpus_imports(spark, sf_dir):
    return parsed_corpus(spark).select("project", "ordinal", "path", "scan_status", "line_count", F.array_join("imports", ",").alias("imports"))


def corpus_matches(spark, sf_dir):
    return match.pattern_matches(parsed_corpus(spark), catalog(spark))


def corpus_rating(spark, sf_dir):
    return Analysis(corpus(spark)).rating


def corpus_summary(spark, sf_dir):
    out = Analysis(corpus(spark)).summary
    return out.select("project", "total_functions", "average_confidence", F.to_json("time_complexity_distribution").alias("time_complexity_distribution"), F.to_json("space_complexity_distribution").alias("space_complexity_distribution"), "high_complexity_count", F.to_json("high_complexity_functions").alias("high_complexity_functions"))


def rounding(spark, sf_dir):
    """Fortieths, many of which lie half-way between two tenths or hundredths, in decimal or in binary."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") * 7 + F.col("l_linenumber")).cast("double") / 40).alias("x"))
    return x.select("l_orderkey", "l_linenumber", py_round(F.col("x"), 1).alias("tenths"), py_round(F.col("x"), 2).alias("hundredths"))


def average_confidence(spark, sf_dir):
    return cx.complexity_totals(classes(spark, sf_dir)).select("project", "total_functions", "average_confidence", "high_complexity_count")


QUERIES = {
    "rating_by_source": project_rating,
    "line_counts": line_counts, "page_line_counts": page_line_counts, "project_sizes": project_sizes,
    "keyword_matches": keyword_matches, "pattern_files": files_of_patterns, "pattern_totals": pattern_totals, "pattern_top3": top3_files, "pattern_counts": pattern_counts,
    "import_matches_cumulative": imports_cumulative, "import_matches_file": imports_of_file,
    "project_scores": project_scores, "score_grid": score_grid,
    "time_class": _of("time_complexity", "reason"), "space_class": _of("space_complexity"), "confidence": _of("confidence"), "dominant_operation": _of("dominant_operation"), "recursion_type": _of("recursion_type"), "loop_depth_class": _of("loop_depth_class"),
    "time_distribution": lambda s, d: cx.distribution(classes(s, d), "time_complexity"), "space_distribution": lambda s, d: cx.distribution(classes(s, d), "space_complexity"),
    "high_complexity": lambda s, d: cx.high_complexity(classes(s, d)).select("l_orderkey", "l_linenumber", "time_complexity"), "high_top10": high_top10,
    "average_confidence": average_confidence,
    "path_scope": path_scope, "rounding": rounding,
    "corpus_functions": corpus_functions, "corpus_imports": corpus_imports, "corpus_matches": corpus_matches, "corpus_rating": corpus_rating, "corpus_summary": corpus_summary,
    **generated.QUERIES,
}


def quoted(x) -> str:
    if isinstance(x, str):
        plain = x.replace("'", "''").split("\n")
        return " || chr(10) || ".join(" || chr(13) || ".join(f"'{y}'" for y in p.split("\r")) for p in plain)
    return "[" + ", ".join(map(quoted, x)) + "]::VARCHAR[]" if isinstance(x, list) else str(x)


def values(rows: list[tuple], columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS t({columns})"


LINES = r"""(len(regexp_extract_all({c}, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]')) + CASE WHEN length({c}) > 0 AND NOT regexp_matches({c}, '(?:\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}])\z') THEN 1 ELSE 0 END)::BIGINT"""
CATALOG = f"catalog AS (SELECT * FROM {values(entries(), 'category, pattern, pattern_ord, weight, description, keywords, imports')})"
DOCUMENT_FILES = "SELECT source AS project, doc_id AS ordinal, doc_id::VARCHAR || '.txt' AS path, text AS content FROM documents"
MATCHES = f"""{CATALOG}, files AS ({DOCUMENT_FILES} UNION ALL SELECT * FROM {values(CORPUS, 'project, ordinal, path, content')}),
words AS (SELECT category, pattern, pattern_ord, lower(unnest(keywords)) AS k FROM catalog),
matches AS (SELECT DISTINCT project, ordinal, path, category, pattern FROM files, words WHERE contains(lower(content), k))"""
HITS = f"""{CATALOG}, files AS (SELECT project, ordinal, imports AS names FROM {values(IMPORTS, 'project, ordinal, imports')}),
wanted AS (SELECT category, pattern, lower(unnest(imports)) AS i FROM catalog),
hits AS (SELECT f.project, f.ordinal, p.category, p.pattern, coalesce(bool_or(contains(lower(n.name), w.i)), false) AS hit
  FROM files f CROSS JOIN (SELECT category, pattern FROM catalog) p LEFT JOIN wanted w USING (category, pattern) LEFT JOIN (SELECT project, ordinal, unnest(names) AS name FROM files) n ON n.project = f.project AND n.ordinal = f.ordinal GROUP BY ALL)"""


#: What scores and labels must be, written out for the SQL: (weight below which a piece holds, score at its start, weight there, slope).
DSA_SQL = [(2, 2.0, 0, 1.0), (5, 4.0, 2, 0.67), (10, 6.0, 5, 0.4), (None, 8.0, 10, 0.1)]
DESIGN_SQL = [(3, 2.0, 0, 0.67), (8, 4.0, 3, 0.4), (15, 6.0, 8, 0.29), (None, 8.0, 15, 0.1)]
LABEL_SQL = "CASE WHEN {x} <= 2 THEN 'Poor - Minimal value, basic code' WHEN {x} <= 4 THEN 'Below Average - Simple structures only' WHEN {x} <= 6 THEN 'Average - Some DSA/design patterns' WHEN {x} <= 8 THEN 'Good - Strategic DSA and design' ELSE 'Excellent - Comprehensive architecture' END"


def pieces_sql(w: str, pieces: list[tuple]) -> str:
    out = f"CASE WHEN {w} IS NULL THEN 1.0::DOUBLE"
    for below, start, origin, slope in pieces:
        value = f"({start}::DOUBLE + ({w} - {origin}) * {slope}::DOUBLE)"
        out += f" ELSE least(10.0, {value}) END" if below is None else f" WHEN {w} < {below} THEN {value}"
    return out


BONUS = "CASE WHEN {f} = 0 THEN 0.0::DOUBLE ELSE least(5.0::DOUBLE, {f} / 5.0::DOUBLE) + least(5.0::DOUBLE, {n} / 500.0::DOUBLE) END"
RAW = "greatest(1.0::DOUBLE, least(10.0::DOUBLE, dsa_score * 0.4::DOUBLE + design_score * 0.5::DOUBLE + {b} * 0.1::DOUBLE))"
KIND = "CASE recursive_calls WHEN 0 THEN NULL WHEN 1 THEN 'linear' WHEN 2 THEN 'binary' ELSE 'multiple' END"
CLASSES = f"""WITH facts AS ({FACTS_SQL}), classes AS (SELECT *, {KIND} AS recursion_type,
  CASE WHEN recursive_calls > 0 THEN CASE WHEN uses_memo OR recursive_calls = 1 THEN 'O(n)' WHEN recursive_calls = 2 THEN 'O(2^n)' ELSE 'O(k^n)' END
    WHEN max_loop_depth = 0 THEN CASE WHEN has_sort THEN 'O(n log n)' ELSE coalesce(first_cost, 'O(1)') END
    WHEN max_loop_depth = 1 THEN CASE WHEN has_log_n THEN 'O(log n)' WHEN has_sort THEN 'O(n log n)' ELSE 'O(n)' END
    WHEN max_loop_depth = 2 THEN CASE WHEN has_log_n THEN 'O(n log n)' ELSE 'O(n²)' END
    WHEN max_loop_depth = 3 THEN 'O(n³)' ELSE 'O(n^' || max_loop_depth || ')' END AS time_complexity,
  CASE WHEN recursive_calls > 0 THEN CASE WHEN uses_memo THEN 'Recursive (' || {KIND} || ') with memoization → O(n)' WHEN recursive_calls = 1 THEN 'Linear recursion without memoization → O(n)' WHEN recursive_calls = 2 THEN 'Binary recursion without memoization → O(2^n)' ELSE 'Multiple recursion (' || recursive_calls || ' calls) → O(k^n)' END
    WHEN max_loop_depth = 0 THEN CASE WHEN has_sort THEN 'No loops but uses sorting → O(n log n)' WHEN first_cost IS NOT NULL THEN 'Uses ' || first_op || '() → ' || first_cost ELSE 'No loops or expensive operations → O(1)' END
    WHEN max_loop_depth = 1 THEN CASE WHEN has_log_n THEN 'Single loop with log n iterations → O(log n)' WHEN has_sort THEN 'Single loop + sorting → O(n log n)' WHEN first_loop_exits THEN 'Single loop with early exit → O(n) worst case' ELSE 'Single loop over input → O(n)' END
    WHEN max_loop_depth = 2 THEN CASE WHEN has_log_n THEN 'Nested loops with log n inner → O(n log n)' ELSE 'Nested loops (depth 2) → O(n²)' END
    WHEN max_loop_depth = 3 THEN 'Triple nested loops → O(n³)' ELSE 'Deep nesting (depth ' || max_loop_depth || ') → O(n^' || max_loop_depth || ')' END AS reason,
  CASE WHEN recursive_calls > 0 THEN 'O(n)' ELSE coalesce(first_power, CASE WHEN has_linear THEN 'O(n)' END, 'O(1)') END AS space_complexity,
  greatest(0.3::DOUBLE, 0.8::DOUBLE - CASE WHEN recursive_calls > 0 AND NOT uses_memo THEN 0.2::DOUBLE ELSE 0::DOUBLE END - CASE WHEN max_loop_depth > 2 THEN 0.1::DOUBLE ELSE 0::DOUBLE END - CASE WHEN n_typed = 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END) AS confidence,
  CASE WHEN recursive_calls > 0 THEN 'recursion (' || {KIND} || ')' WHEN max_loop_depth > 0 THEN 'nested loops (depth ' || max_loop_depth || ')' ELSE first_op END AS dominant_operation,
  CASE max_loop_depth WHEN 0 THEN 'O(1)' WHEN 1 THEN 'O(n)' WHEN 2 THEN 'O(n²)' WHEN 3 THEN 'O(n³)' ELSE 'O(n^k)' END AS loop_depth_class
FROM facts) """
HIGH = "(" + " OR ".join(f"contains(time_complexity, '{x}')" for x in cx.HIGH) + ")"
_class_sql = lambda *c: f"{CLASSES} SELECT l_orderkey, l_linenumber, {', '.join(c)} FROM classes"

#: The report of projects from their `found` patterns and `sizes`.
RATED = f"""w AS (SELECT project, sum(CASE WHEN category = 'dsa' THEN round(weight * 10)::BIGINT END) / 10.0::DOUBLE AS dsa, sum(CASE WHEN category = 'design' THEN round(weight * 10)::BIGINT END) / 10.0::DOUBLE AS design,
    count(CASE WHEN category = 'dsa' THEN 1 END)::INTEGER AS dsa_patterns_count, count(CASE WHEN category = 'design' THEN 1 END)::INTEGER AS design_patterns_count FROM found JOIN catalog USING (category, pattern) GROUP BY project),
  x AS (SELECT project, files_scanned, total_lines, coalesce(dsa_patterns_count, 0)::INTEGER AS dsa_patterns_count, coalesce(design_patterns_count, 0)::INTEGER AS design_patterns_count,
    {pieces_sql('dsa', DSA_SQL)} AS dsa_score, {pieces_sql('design', DESIGN_SQL)} AS design_score,
    {BONUS.format(f='files_scanned', n='total_lines')} AS bonus FROM sizes LEFT JOIN w USING (project)),
  r AS (SELECT *, format('{{:.1f}}', {RAW.format(b='bonus')})::DOUBLE AS rating FROM x)
  SELECT project, rating, {LABEL_SQL.format(x='rating')} AS label,
    format('{{:.2f}}', dsa_score)::DOUBLE AS dsa_score, format('{{:.2f}}', design_score)::DOUBLE AS design_score, format('{{:.2f}}', bonus)::DOUBLE AS complexity_bonus, dsa_patterns_count, design_patterns_count, files_scanned, total_lines FROM r"""

#: Facts of CORPUS, taken by hand: project, ordinal, status, lines, imports.
CORPUS_FACTS = [
    ("leak", 0, "ok", 1, []), ("leak", 1, "ok", 1, ["fastapi"]), ("leak", 2, "ok", 1, []), ("graph", 0, "ok", 1, []), ("graph", 1, "ok", 2, ["networkx", "collections", "collections.deque", "collections.OrderedDict"]), ("graph", 2, "ok", 3, ["m", "m.y", "m.*"]),
    ("py2", 0, "syntax_error", 2, []), ("py2", 1, "ok", 1, []), ("algo", 0, "ok", 8, []), ("algo", 1, "ok", 9, []), ("algo", 2, "ok", 8, ["functools", "functools.lru_cache"]), ("algo", 3, "ok", 2, []), ("algo", 4, "ok", 3, []),
    ("web", 0, "ok", 9, ["logging", "fastapi", "fastapi.FastAPI", "fastapi.Depends"]), ("web", 1, "ok", 4, ["pytest"]), ("empty", 0, "ok", 0, []),
]
CORPUS_SQL = f"""{CATALOG}, corpus AS (SELECT * FROM {values(CORPUS, 'project, ordinal, path, content')}), facts AS (SELECT * FROM {values(CORPUS_FACTS, 'project, ordinal, scan_status, line_count, imports')}),
  words AS (SELECT category, pattern, pattern_ord, lower(unnest(keywords)) AS k FROM catalog), wanted AS (SELECT category, pattern, pattern_ord, lower(unnest(imports)) AS i FROM catalog),
  named AS (SELECT project, ordinal, lower(unnest(imports)) AS name FROM facts), first_hit AS (SELECT project, category, pattern, pattern_ord, min(ordinal) AS first FROM named, wanted WHERE contains(name, i) GROUP BY ALL),
  hits AS (SELECT project, ordinal, path, category, pattern, pattern_ord, true AS k, false AS i FROM corpus, words WHERE contains(lower(content), words.k)
    UNION ALL SELECT c.project, c.ordinal, c.path, h.category, h.pattern, h.pattern_ord, false, true FROM corpus c JOIN first_hit h ON c.project = h.project AND c.ordinal >= h.first),
  matches AS (SELECT project, ordinal, path, category, pattern, pattern_ord, bool_or(k) AS by_keyword, bool_or(i) AS by_import FROM hits GROUP BY ALL)"""

ORACLE_SQL = {
    "corpus_imports": f"WITH {CORPUS_SQL} SELECT project, ordinal, path, scan_status, line_count::BIGINT AS line_count, array_to_string(imports, ',') AS imports FROM corpus JOIN facts USING (project, ordinal)",
    "corpus_matches": f"WITH {CORPUS_SQL} SELECT project, ordinal, path, category, pattern, pattern_ord, by_keyword, by_import FROM matches",
    "corpus_rating": f"WITH {CORPUS_SQL}, found AS (SELECT DISTINCT project, category, pattern FROM matches), sizes AS (SELECT project, count(*) AS files_scanned, sum(line_count)::BIGINT AS total_lines FROM facts GROUP BY project), {RATED}",
    "line_counts": f"SELECT source AS project, doc_id AS ordinal, {LINES.format(c='text')} AS line_count FROM documents",
    "page_line_counts": f"SELECT page_id, {LINES.format(c='html')} AS line_count FROM pages",
    "project_sizes": f"SELECT source AS project, count(*) AS files_scanned, sum({LINES.format(c='text')})::BIGINT AS total_lines FROM documents GROUP BY source",
    "keyword_matches": f"WITH {MATCHES} SELECT project, ordinal, path, category, pattern FROM matches",
    "pattern_files": f"WITH {MATCHES} SELECT project, category, pattern, row_number() OVER (PARTITION BY project, category, pattern ORDER BY ordinal, path)::INTEGER AS position, path FROM matches",
    "pattern_totals": f"WITH {MATCHES} SELECT project, category, pattern, min(ordinal) AS first_ordinal, count(*) AS n_files, any_value(description) AS description FROM matches JOIN catalog USING (category, pattern) GROUP BY project, category, pattern",
    "pattern_top3": f"WITH {MATCHES} SELECT project, category, pattern, array_to_string(list(path ORDER BY ordinal)[1:3], ',') AS files FROM matches GROUP BY project, category, pattern",
    "pattern_counts": f"WITH {MATCHES} SELECT project, category, count(DISTINCT pattern) AS n_patterns FROM matches GROUP BY project, category",
    "import_matches_cumulative": f"WITH {HITS} SELECT project, ordinal, category, pattern FROM (SELECT *, bool_or(hit) OVER (PARTITION BY project, category, pattern ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS now FROM hits) WHERE now",
    "import_matches_file": f"WITH {HITS} SELECT project, ordinal, category, pattern FROM hits WHERE hit",
    "project_scores": f"""WITH {CATALOG}, words AS (SELECT category, pattern, lower(unnest(keywords)) AS k FROM catalog),
        files AS ({DOCUMENT_FILES}), found AS (SELECT DISTINCT project, category, pattern FROM files, words WHERE contains(lower(content), k)),
        w AS (SELECT project, sum(CASE WHEN category = 'dsa' THEN round(weight * 10)::BIGINT END)::BIGINT AS dsa_weight_tenths, sum(CASE WHEN category = 'design' THEN round(weight * 10)::BIGINT END)::BIGINT AS design_weight_tenths,
              count(CASE WHEN category = 'dsa' THEN 1 END)::INTEGER AS dsa_patterns_count, count(CASE WHEN category = 'design' THEN 1 END)::INTEGER AS design_patterns_count FROM found JOIN catalog USING (category, pattern) GROUP BY project),
        s AS (SELECT source AS project, count(*) AS files_scanned, sum({LINES.format(c='text')})::BIGINT AS total_lines FROM documents GROUP BY source),
        x AS (SELECT project, dsa_weight_tenths, design_weight_tenths, coalesce(dsa_patterns_count, 0)::INTEGER AS dsa_patterns_count, coalesce(design_patterns_count, 0)::INTEGER AS design_patterns_count, files_scanned, total_lines,
              {pieces_sql('(dsa_weight_tenths / 10.0)::DOUBLE', DSA_SQL)} AS dsa_score, {pieces_sql('(design_weight_tenths / 10.0)::DOUBLE', DESIGN_SQL)} AS design_score, {BONUS.format(f='files_scanned', n='total_lines')} AS bonus FROM s LEFT JOIN w USING (project))
        SELECT project, dsa_weight_tenths, design_weight_tenths, round(dsa_score, 6) AS dsa_score, round(design_score, 6) AS design_score, round(bonus, 6) AS complexity_bonus, round({RAW.format(b='bonus')}, 6) AS raw_rating, dsa_patterns_count, design_patterns_count, files_scanned, total_lines FROM x""",
    "score_grid": f"""WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE ((o_orderkey * 7) % 512 / 10.0)::DOUBLE END AS w, o_custkey % 40 AS f, (o_custkey * 13) % 4000 AS n FROM orders),
        x AS (SELECT *, {pieces_sql('w', DSA_SQL)} AS dsa_score, {pieces_sql('w', DESIGN_SQL)} AS design_score, {BONUS.format(f='f', n='n')} AS bonus FROM g),
        y AS (SELECT *, round({RAW.format(b='bonus')}, 6) AS raw FROM x)
        SELECT o_orderkey, round(dsa_score, 6) AS dsa_score, round(design_score, 6) AS design_score, round(bonus, 6) AS size_bonus, raw AS raw_rating, {LABEL_SQL.format(x='raw')} AS label, CASE WHEN raw < 4 THEN 'red' WHEN raw < 7 THEN 'yellow' ELSE 'green' END AS color FROM y""",
    "time_class": _class_sql("time_complexity", "reason"), "space_class": _class_sql("space_complexity"), "confidence": _class_sql("confidence"), "dominant_operation": _class_sql("dominant_operation"), "recursion_type": _class_sql("recursion_type"), "loop_depth_class": _class_sql("loop_depth_class"),
    "time_distribution": f"{CLASSES} SELECT 'p' AS project, time_complexity, count(*) AS n_functions FROM classes GROUP BY time_complexity",
    "space_distribution": f"{CLASSES} SELECT 'p' AS project, space_complexity, count(*) AS n_functions FROM classes GROUP BY space_complexity",
    "high_complexity": f"{CLASSES} SELECT l_orderkey, l_linenumber, time_complexity FROM classes WHERE {HIGH}",
    "high_top10": f"{CLASSES} SELECT l_orderkey, l_linenumber, time_complexity FROM classes WHERE {HIGH} ORDER BY l_orderkey, l_linenumber LIMIT 10",
    "average_confidence": f"{CLASSES} SELECT 'p' AS project, count(*) AS total_functions, format('{{:.2f}}', sum(round(confidence * 100)) / 100 / count(*))::DOUBLE AS average_confidence, count(CASE WHEN {HIGH} THEN 1 END) AS high_complexity_count FROM classes",
    "path_scope": f"""WITH p AS (SELECT path, string_split(path, '/')[:-2] AS folders FROM {values([(p,) for p in PATHS], 'path')}),
        s AS (SELECT *, suffix(path, '.py') AND NOT list_has_any(folders, ['.git', '__pycache__', '.venv', 'venv', 'node_modules', '.pytest_cache', 'dist', 'build']) AS in_scan FROM p)
        SELECT path, in_scan, in_scan AND NOT list_has_any(folders, ['.tox', '.eggs']) AS in_complexity FROM s""",
    "rounding": "SELECT l_orderkey, l_linenumber, format('{:.1f}', x)::DOUBLE AS tenths, format('{:.2f}', x)::DOUBLE AS hundredths FROM (SELECT l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber)::DOUBLE / 40 AS x FROM lineitem)",
    "rating_by_source": f"WITH {CATALOG}, words AS (SELECT category, pattern, lower(unnest(keywords)) AS k FROM catalog), files AS ({DOCUMENT_FILES}), found AS (SELECT DISTINCT project, category, pattern FROM files, words WHERE contains(lower(content), k)), sizes AS (SELECT source AS project, count(*) AS files_scanned, sum({LINES.format(c='text')})::BIGINT AS total_lines FROM documents GROUP BY source), {RATED}",
    **generated.oracle_sql(CATALOG, RATED),
}
