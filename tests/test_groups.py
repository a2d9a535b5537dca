"""Files in groups of the same facts against files parsed one by one."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltscope.operators import complexity, extract, match, score
from siltscope.operators.extract import Facts, parse, parse_groups
from siltscope.plans import generated
from siltscope.sources.catalog import SCHEMA, catalog, entries
from siltscope.sources.listing import files_from

SAME = "import heapq\ndef {0}(xs: list, n):\n    for x in xs:\n        y = sorted(xs)\n        {0}(xs, n - 1)\n        self.{0}(n)\n    return n\n"
#: Texts with a name at {0}; what is in place of it changes more than the name in some.
TEXTS = [
    SAME, "def {0}():\n    x = 1.{0}\n", "def {0}():\n    return {0}'a'\n", "def {0}(a: '{0}'):\n    pass\n", "def {0}():\n    for {0} in {0}(1):\n        z = {0}\n", "x = 1{0}\ndef {0}(a):\n    return a\n", "def {0}(a):\n    return a{0}, {0}a, {0}{0}\n",
    "def {0}(a):\n    return '\\{0}'\n", "def {0}(a: {0}, b: 'x'):\n    for i in range({0}):\n        pass\n", "def {0}(a):\n    # {0}\n    return é\n", "import {0}\ndef {0}(a):\n    return a\n", "class A:\n    def {0}(self):\n        return {0}\n    def g(self):\n        return {0}(self.{0})\n",
    "async def {0}(x):\n    print {0}\n", "def {0}(x):\n    match x:\n        case {0}: return [a for a in x]\n        case _: return {0}(1)\n", "@{0}\ndef {0}(x):\n    return x.{0}()\n\x0c\n", "def {0}(x):\n    return 0x{0}\r\n", "def \tf(x): pass\ndef {0}(x): return f(f(x))\n", "x = '''\ndef {0}(x):\n'''\n",
]
NAMES = ["f1", "f2_33", "f2_4", "e5", "rb", "r", "_", "match", "len", "set", "sorted", "list", "lru_cache", "cache", "type", "print", "get", "offset", "bfs2", "find_all", "g", "x", "a", "self", "name", "case", "range", "zip", "unknown", "A", "dag", "class", "f"]
EVERY = [t.replace("{0}", n) for t in TEXTS for n in NAMES] + [None, "", "x = 1", "def f1(:\n", "import redis\n", "def f(x):\n" + "  " * 9 + "return 1\n", "def f1(x):\n    return '\0'\n", "İ = 'DICT'\n", "K = 1\n"]


def plain(content):
    return (*parse(content), None if content is None else len(content.splitlines()))


def test_facts_of_a_shape_are_those_of_each_text():
    known = Facts()
    for content in [*EVERY, *EVERY[::-1]]:
        (status, imports, functions, lines), name = known.of(content)
        functions = [f | {"name": name if f["name"] is None else f["name"]} for f in functions]
        assert (status, imports, functions, lines) == plain(content), content


def test_a_shape_is_parsed_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(extract, "parse", lambda c: parsed.append(c) or parse(c))
    known = Facts()
    for k in range(500):
        known.of(SAME.replace("{0}", f"f{k}_{k % 7}"))
    assert len(parsed) == 1


def test_few_shapes_are_kept(monkeypatch):
    monkeypatch.setattr(extract, "SHAPES", 5)
    known = Facts()
    for content in EVERY:
        known.of(content)
        assert len(known.shapes) <= 5


def corpus(spark):
    """Odd texts in a few projects, with nulls in every key and files that come twice."""
    rows = [(None if k % 41 == 7 else "pqr"[k % 3], None if k % 53 == 9 else (k * 7) % 400, f"{'.tox/' if k % 19 == 3 else ''}{k % 300}.py", c) for k, c in enumerate(EVERY)]
    rows += [(p, o, path, "x = dict()\n") for p, o, path, _ in rows[::5]]
    return files_from(spark.createDataFrame(rows, "project string, ordinal long, path string, content string").repartition(3))


def alike(a, b):
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("more", [0, 40], ids=["built in", "more than 64 patterns, digits, nulls"])
def test_matches(spark, more):
    rows = [*entries(), *[("dsa", f"p{k}", 100 + k, 1.0, "", [f"f{k}", None, "_33"], [f"heapq{k}" if k else "heapq", None]) for k in range(more)]]
    rows += [("dsa", "p1", 101, 1.0, "", None, ["redis"]), ("dsa", "p2", 102, 1.0, "", ["E5"], None)] if more else []
    c = spark.createDataFrame(rows, SCHEMA) if more else catalog(spark)
    files = corpus(spark)
    alike(match.file_matches(files, c), match.pattern_matches(extract.parse_files(files), c).select("project", *match.KEY, "ordinal", "path", "by_keyword", "by_import"))


def test_files_are_parsed_once_for_their_matches(spark, tmp_path):
    lineitem(spark, tmp_path)
    plan = generated.matches(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 1


def lineitem(spark, folder, rows=400):
    k = F.col("id")
    spark.range(rows).select((k / 3).cast("long").alias("l_orderkey"), (k * 7).alias("l_partkey"), (k * 11).alias("l_suppkey"), (k % 7).cast("int").alias("l_linenumber")).write.parquet(f"{folder}/lineitem.parquet")


def test_groups_are_made_in_parts(spark):
    """Every file is in one group, however many groups a task gives out at a time: after long texts it gives out what it has."""
    long = spark.range(6).select(F.lit("p"), "id", F.lit("long.py"), F.concat(F.lit("x = 1 #"), F.repeat(F.lit("a"), F.lit(1 << 19)), F.lit("\ny = 2")), F.lit(True), F.lit(None).cast("string"))
    files = corpus(spark).unionAll(long).repartition(2)
    g = parse_groups(files, ["project", "ordinal", "path"])
    got = g.select("scan_status", "line_count", F.explode("members").alias("m")).select("m.project", "m.ordinal", "m.path", "scan_status", "line_count")
    alike(got, extract.parse_files(files).select("project", "ordinal", "path", "scan_status", "line_count"))


@pytest.mark.parametrize("nulls", [False, True])
def test_first_matches(spark, nulls):
    """The sizes and weights of projects are those of files parsed one by one, with nulls in the keys and files that come twice."""
    files, c = corpus(spark).where("true" if nulls else "project IS NOT NULL AND ordinal IS NOT NULL"), catalog(spark)
    parsed = extract.parse_files(files)
    sizes, first = match.first_matches(files, c)
    alike(sizes, score.project_sizes(parsed))
    alike(score.pattern_weights(first, c), score.pattern_weights(match.pattern_matches(parsed, c), c))


def test_files_are_parsed_once_for_their_rating(spark, tmp_path):
    lineitem(spark, tmp_path)
    plan = generated.rating(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 1


def test_files_of_groups(spark, tmp_path):
    """The query has the files' own rows, and no text comes back from the parser."""
    lineitem(spark, tmp_path)
    got = generated.files(spark, str(tmp_path))
    one = extract.parse_files(generated.sources(spark, str(tmp_path)))
    alike(got, one.select("project", "ordinal", "path", "scan_status", "line_count", F.array_join("imports", ",").alias("imports")))
    assert "members" in got._jdf.queryExecution().optimizedPlan().toString()


def test_functions_of_groups(spark):
    """Functions judged once for a group are those judged one by one."""
    files = corpus(spark)
    columns = ["line", "time_complexity", "space_complexity", "confidence", "reasoning", "has_recursion", "recursion_type", "uses_memoization", "has_early_exit", "dominant_operation", "loop_analysis"]
    f = complexity.judged(parse_groups(files.where("in_complexity_scope"), ["project", "ordinal", "path"]), "members")
    variables = F.array_sort(F.map_values("variables")).alias("variables")
    got = f.select("walk_idx", "name", *columns, variables, F.explode("members").alias("m")).select("m.project", "m.ordinal", "m.path", "walk_idx", F.coalesce("name", "m.name").alias("name"), *columns, "variables")
    alike(got, complexity.function_complexity(extract.parse_files(files)).select("project", "ordinal", "path", "walk_idx", "name", *columns, variables))


def test_functions_are_judged_in_groups(spark, tmp_path):
    lineitem(spark, tmp_path)
    got = generated.functions(spark, str(tmp_path))
    one = complexity.function_complexity(extract.parse_files(generated.sources(spark, str(tmp_path))))
    plain = ["project", "ordinal", "path", "walk_idx", "name", "line", "time_complexity", "space_complexity", "confidence", "dominant_operation"]
    alike(got.select(*plain), one.select(*plain))
    assert "members" in got._jdf.queryExecution().optimizedPlan().toString()


def test_totals_read_functions_once(spark, tmp_path):
    lineitem(spark, tmp_path)
    got = generated.summary(spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0
    one = complexity.function_complexity(extract.parse_files(generated.sources(spark, str(tmp_path)))).cache()
    want = {}
    for r in one.collect():
        want.setdefault(r.project, []).append(r)
    assert got.count() == len(want) == 10
    for r in got.collect():
        rows = want[r.project]
        spread = lambda c: dict(Counter(x[c] for x in rows))  # noqa: E731,B023
        assert (r.total_functions, r.average_confidence) == (len(rows), round(sum(round(x.confidence * 100) for x in rows) / 100 / len(rows), 2))
        assert r.high_complexity_count == sum(any(h in x.time_complexity for h in complexity.HIGH) for x in rows)
        assert (json.loads(r.time_complexity_distribution), json.loads(r.space_complexity_distribution)) == (spread("time_complexity"), spread("space_complexity"))
    assert complexity.complexity_totals(one.where("false")).count() == 0
