import random

import pytest
from pyspark.sql import functions as F

from siltscope.functions.scalars import line_count, py_round, register
from siltscope.operators import match, score
from siltscope.operators.extract import parse_files
from siltscope.plans.analyzer import analyze
from siltscope.sources.catalog import catalog, entries
from siltscope.sources.listing import files_from


def corpus(spark, rows):
    return files_from(spark.createDataFrame(rows, "project string, ordinal long, path string, content string"))


def found(spark, rows, **how):
    got = match.pattern_matches(parse_files(corpus(spark, rows)), catalog(spark), **how)
    return {(r.project, r.pattern, r.ordinal) for r in got.collect()}


def test_catalog():
    rows = entries()
    assert (len(rows), sum(len(r[5]) for r in rows), sum(len(r[6]) for r in rows)) == (38, 218, 57)
    assert round(sum(r[3] for r in rows if r[0] == "dsa"), 1) == 51.2 and sum(r[3] for r in rows if r[0] == "design") == 28.0


def test_imports_reach_later_files(spark):
    rows = [("p", 0, "a.py", "x = 1\n"), ("p", 1, "b.py", "import networkx\n"), ("p", 2, "c.py", "y = 2\n"), ("q", 0, "d.py", "y = 2\n"), ("r", 0, "e.py", 'import networkx\nprint "x"\n'), ("r", 1, "f.py", "y = 2\n")]
    assert {x for x in found(spark, rows) if x[1] == "graph_traversal"} == {("p", "graph_traversal", 1), ("p", "graph_traversal", 2)}
    assert {x for x in found(spark, rows, import_scope="file") if x[1] == "graph_traversal"} == {("p", "graph_traversal", 1)}
    turned = [("p", 1 - o if o < 2 else o, n, c) for p, o, n, c in rows[:3]]
    assert {x[2] for x in found(spark, turned) if x[1] == "graph_traversal"} == {0, 1, 2}


@pytest.mark.parametrize(("text", "pattern"), [("offset(1)\n", "set_operations"), ("# arbitrary\n", "fenwick_tree"), ("value = dict()\n", "hash_map"), ("import os\n", None), ("DAG = 1", "topological_sort")])
def test_substrings(spark, text, pattern):
    got = {x[1] for x in found(spark, [("p", 0, "a.py", text)])}
    assert (pattern in got) if pattern else not got


def test_rating_of_a_small_project(spark):
    rows = [("p", 0, "a.py", "x = 1\n"), ("p", 1, "b.py", "import fastapi\n"), ("p", 2, "c.py", "y = 2\n")]
    r = analyze(corpus(spark, rows)).rating.first()
    assert (r.rating, r.label, r.dsa_score, r.design_score, r.complexity_bonus) == (2.1, "Below Average - Simple structures only", 1.0, 3.34, 0.61)
    assert (r.dsa_patterns_count, r.design_patterns_count, r.files_scanned, r.total_lines) == (0, 1, 3, 3)


def plain_score(w, pieces):
    if w is None:
        return 1.0
    for below, start, origin, slope in pieces:
        if below is None:
            return min(10, start + (w - origin) * slope)
        if w < below:
            return start + (w - origin) * slope


def test_scores_on_a_grid(spark):
    weights = [None, 0, 1.2, 1.9, 2, 2.9, 3, 4.9, 5, 7.9, 8, 9.9, 10, 14.9, 15, 28, 29.9, 30, 51.2]
    df = spark.createDataFrame([(i, w if w is None else float(w)) for i, w in enumerate(weights)], "i int, w double")
    for r in df.select("i", score.dsa_score(F.col("w")).alias("d"), score.design_score(F.col("w")).alias("s")).collect():
        assert r.d == pytest.approx(plain_score(weights[r.i], score.DSA_PIECES)) and r.s == pytest.approx(plain_score(weights[r.i], score.DESIGN_PIECES))


def test_empty_project_and_best_one(spark):
    projects = spark.createDataFrame([("none",), ("best",)], "project string")
    sizes = spark.createDataFrame([("best", 30, 3000)], "project string, files_scanned long, total_lines long")
    weights = spark.createDataFrame([("best", 51.2, 28.0, 24, 14)], "project string, dsa_weight double, design_weight double, dsa_patterns_count int, design_patterns_count int")
    got = {r.project: r for r in score.rate(projects, sizes, weights).collect()}
    assert (got["none"].rating, got["none"].label, got["none"].files_scanned) == (1.0, "Poor - Minimal value, basic code", 0)
    assert got["best"].rating == 9.7 and got["best"].label.startswith("Excellent")


def test_unknown_patterns_count_but_weigh_nothing(spark):
    m = spark.createDataFrame([("p", "dsa", "nonsense", 0)], "project string, category string, pattern string, ordinal long")
    r = score.pattern_weights(m, catalog(spark)).first()
    assert (r.dsa_weight, r.dsa_patterns_count) == (0.0, 1)


def test_line_count_is_splitlines(spark):
    random.seed(5)
    parts = ["a", "bc", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "é", " "]
    texts = ["", "a", "a\n", "a\r\nb", "a\x0cb\x1cc\u2028d\x85e", "\n\n", *("".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(3000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert all(r.n == len(texts[r.i].splitlines()) for r in df.select("i", line_count("t").alias("n")).collect())


def test_rounding(spark):
    random.seed(1)
    xs = [5.25, 4.35, 0.725, 2.675, *(random.random() * 10 for _ in range(500))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", py_round(F.col("x"), 1).alias("a"), py_round(F.col("x"), 2).alias("b"))
    assert all((r.a, r.b) == (round(xs[r.i], 1), round(xs[r.i], 2)) for r in df.collect())


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT py_round(2.675D, 2)").first()[0] == 2.67
    spark.createDataFrame([("def f(n):\n    return f(n)\n",)], "content string").createOrReplaceTempView("sources")
    r = spark.sql("SELECT p.status, size(p.functions) AS n FROM sources, LATERAL parse_python(content) p").first()
    assert (r.status, r.n) == ("ok", 1)


def test_order_of_rows_changes_nothing(spark):
    rows = [("p", i, f"{i}.py", t) for i, t in enumerate(["x = dict()\n", "import heapq\n", "set()\n", "pop = 1\n", "def f(xs):\n    return [x for x in xs]\n"])]
    want = analyze(corpus(spark, rows)).rating.first()
    random.seed(2)
    random.shuffle(rows)
    assert analyze(corpus(spark, rows).repartition(3)).rating.first() == want
