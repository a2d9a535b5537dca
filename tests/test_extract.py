"""One small source for each rule of the extractor and of the classes. `;` parts lines, `>` is a level of indent."""

import ast

import pytest
from pyspark.sql import functions as F

from siltscope.operators.complexity import complexity_summary, function_complexity
from siltscope.operators.extract import function_facts, imported, parse, parse_files
from siltscope.sources.listing import files_from

H, G, T6, T5 = 0.8, 0.7000000000000001, 0.6000000000000001, 0.5000000000000001
FIB = "def f(n: int): ; > return n if n < 2 else f(n-1) + f(n-2)"
typed = lambda body: f"def f(xs: list, ys: list, h: list, a: list, lo: int, hi: int, ok: int, n: int): ; > {body}"
CASES = [
    ("def f(): ; > pass", "O(1)", "O(1)", G, None),
    ("def f(x: int): ; > return x", "O(1)", "O(1)", H, None),
    (typed("for x in xs: ; >> print(x)"), "O(n)", "O(1)", H, "nested loops (depth 1)"),
    (typed("for i in range(10): ; >> pass"), "O(n)", "O(1)", H, "nested loops (depth 1)"),
    (typed("for x in xs: ; >> for y in xs: ; >>> pass"), "O(n²)", "O(1)", H, "nested loops (depth 2)"),
    (typed("for x in xs: ; >> for y in xs: ; >>> for z in xs: ; >>>> pass"), "O(n³)", "O(1)", G, "nested loops (depth 3)"),
    (typed("for x in xs: ; >> for y in xs: ; >>> for z in xs: ; >>>> for w in xs: ; >>>>> pass"), "O(n^4)", "O(1)", G, "nested loops (depth 4)"),
    (typed("return sorted(xs)"), "O(n log n)", "O(n)", H, "sorted"),
    (typed("for x in xs: ; >> xs.sort()"), "O(n log n)", "O(1)", H, "nested loops (depth 1)"),
    (typed("for x in xs: ; >> for y in xs: ; >>> sorted(xs)"), "O(n²)", "O(n)", H, "nested loops (depth 2)"),
    (typed("return len(xs)"), "O(1)", "O(1)", H, "len"),
    (typed("return sum(xs)"), "O(n)", "O(1)", H, "sum"),
    (typed("heappush(h, 1)"), "O(log n)", "O(1)", H, "heappush"),
    (typed("return nlargest(3, xs)"), "O(n log k)", "O(1)", H, "nlargest"),
    (typed("xs.extend(ys)"), "O(1)", "O(1)", H, "extend"),
    (typed("while lo < hi: ; >> mid = (lo + hi) // 2"), "O(log n)", "O(1)", H, "nested loops (depth 1)"),
    (typed("while lo < hi: ; >> mid = lo + (hi - lo) // 2"), "O(n)", "O(1)", H, "nested loops (depth 1)"),
    (typed("while lo < hi and ok: ; >> mid = (lo + hi) // 2"), "O(n)", "O(1)", H, "nested loops (depth 1)"),
    (typed("while True: ; >> n = n // 2"), "O(n)", "O(1)", H, "nested loops (depth 1)"),
    (typed("while n > 1: ; >> n //= 2"), "O(n)", "O(1)", H, "nested loops (depth 1)"),
    (typed("for x in xs: ; >> while lo < hi: ; >>> mid = (lo + hi) // 2"), "O(n log n)", "O(1)", H, "nested loops (depth 2)"),
    ("def f(n: int): ; > return 1 if n < 2 else n * f(n - 1)", "O(n)", "O(n)", T6, "recursion (linear)"),
    (FIB, "O(2^n)", "O(n)", T6, "recursion (binary)"),
    ("@lru_cache(maxsize=None) ; " + FIB, "O(n)", "O(n)", H, "recursion (binary)"),
    ("@functools.lru_cache(maxsize=None) ; " + FIB, "O(n)", "O(n)", H, "recursion (binary)"),
    ("@functools.cache ; " + FIB, "O(2^n)", "O(n)", T6, "recursion (binary)"),
    ("def f(n: int): ; > return f(n-1) + f(n-2) + f(n-3)", "O(k^n)", "O(n)", T6, "recursion (multiple)"),
    ("class A(B): ; > def f(self): ; >> super().f()", "O(n)", "O(n)", T5, "recursion (linear)"),
    (typed("return [x for x in xs]"), "O(n)", "O(n)", H, "nested loops (depth 1)"),
    (typed("return [x for a in xs for x in a]"), "O(n²)", "O(n^2)", H, "nested loops (depth 2)"),
    (typed("return {k: v for k, v in xs}"), "O(n)", "O(n)", H, "nested loops (depth 1)"),
    (typed("return {x for x in xs}"), "O(1)", "O(1)", H, None),
    (typed("return sum(x for x in xs)"), "O(n)", "O(1)", H, "sum"),
    (typed("return [x for x in [y for y in xs]]"), "O(n²)", "O(n)", H, "nested loops (depth 2)"),
    ("async def f(xs: list): ; > async for x in xs: ; >> pass", "O(1)", "O(1)", H, None),
    (typed("for x in xs: ; >> pass ; > else: ; >> for y in xs: ; >>> pass"), "O(n²)", "O(1)", H, "nested loops (depth 2)"),
    ("def f(x=[y for y in range(3)]): ; > pass", "O(1)", "O(1)", G, None),
    ('def f(x: ""): ; > pass', "O(1)", "O(1)", G, None),
    ("def f(*, x: int): ; > pass", "O(1)", "O(1)", G, None),
    (typed("a = list(xs) ; > b = [i for i in xs for j in xs]"), "O(n²)", "O(n^2)", H, "nested loops (depth 2)"),
    (typed("a = [i for i in xs for j in xs] ; > b = [i for i in xs for j in xs for k in xs]"), "O(n³)", "O(n^2)", G, "nested loops (depth 3)"),
    ("def f(xs: list): ; > def i(ys: list): ; >> for y in ys: ; >>> pass", "O(n)", "O(1)", H, "nested loops (depth 1)"),
]


def source(short: str) -> str:
    lines = [x.strip() for x in short.split(" ; ")]
    return "\n".join(" " * 4 * (len(x) - len(x.lstrip(">"))) + x.lstrip("> ") for x in lines) + "\n"


@pytest.fixture(scope="module")
def judged(spark):
    rows = [("p", k, f"{k}.py", source(c[0])) for k, c in enumerate(CASES)]
    files = files_from(spark.createDataFrame(rows, "project string, ordinal long, path string, content string"))
    return {(r.ordinal, r.name): r for r in function_complexity(parse_files(files)).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_classes(judged, k):
    short, time, space, sure, dominant = CASES[k]
    r = judged[k, "f"]
    assert (r.time_complexity, r.space_complexity, r.confidence, r.dominant_operation) == (time, space, sure, dominant), source(short)


def test_reasons(judged):
    at = next(k for k, c in enumerate(CASES) if c[0].startswith("@lru_cache"))
    assert judged[at, "f"].reasoning == ["Parameters: 1 (1 typed)", "Uses memoization decorator", "Recursive (binary) with memoization → O(n)", "Recursion with memoization → O(n) for cache"]
    two = next(k for k, c in enumerate(CASES) if "a = list(xs)" in c[0])
    assert judged[two, "f"].reasoning[2:] == ["list creates O(n) space", "list_comp creates O(n^2) space"]


@pytest.mark.parametrize(("text", "names"), [
    ("import a.b as c, d", {"a.b", "d"}), ("from m import x as y", {"m", "m.x"}), ("from . import x", set()), ("from .m import x", {"m", "m.x"}), ("from m import *", {"m", "m.*"}), ("def f():\n    import z", {"z"}),
])
def test_imports(text, names):
    assert set(imported(ast.parse(text))) == names


@pytest.mark.parametrize(("text", "status"), [("x = 1", "ok"), ('print "x"', "syntax_error"), ("\ufeffimport redis\n", "syntax_error"), ('x = "\0"', "syntax_error"), (None, "unreadable"), ("", "ok")])
def test_status(text, status):
    assert parse(text)[0] == status


def test_order_of_functions_and_calls():
    tree = "def f():\n    def g(): pass\nclass C:\n    def m(self):\n        def k(): pass\ndef h(): pass\n"
    assert [f["name"] for f in parse(tree)[2]] == ["f", "h", "g", "m", "k"]
    ops = parse("def f(x):\n    x.sort(key=len).copy(list(y), z=set(w))\n")[2][0]["expensive_ops"]
    assert [o["op"] for o in ops] == ["copy", "sort", "list", "set"]


def test_flow_and_loops():
    f = parse("def f(a: list, n):\n    b = a\n    c = [1, 2]\n    for x in b:\n        d = x + 1\n    for i in range(len(b)): pass\n    for i in range(n): pass\n    for j in enumerate(a.z): pass\n    for k in g(a)[0]: break\n")[2][0]
    v = {x["name"]: x for x in f["variables"]}
    assert [(k, v[k]["source"], v[k]["is_input_dependent"]) for k in "abcxd"] == [("a", "parameter", True), ("b", "assignment", True), ("c", "assignment", False), ("x", "loop", True), ("d", "assignment", True)]
    assert (v["a"]["collection_type"], v["c"]["collection_type"], v["c"]["constant_size"]) == ("list", "list", 2)
    assert [(x["iterable_source"], x["is_input_dependent"]) for x in f["loops"]] == [("b", True), ("range(len(b))", True), ("range(n)", True), ("a.z", True), ("g(...)[...]", True)]
    assert [x["has_early_exit"] for x in f["loops"]] == [False, False, False, False, True]


def test_deep_source_is_no_error():
    status, _, functions = parse("def f(a):\n    x = " + " + ".join(["a"] * 3000) + "\n    return x\n")
    assert status in ("ok", "aborted") and (status == "aborted" or functions[0]["n_params"] == 1)


def test_facts_of_a_node():
    node = ast.parse("def f(x: typing.List[int], y: 'list', z: int | None): pass").body[0]
    v = {x["name"]: x for x in function_facts(node)["variables"]}
    assert [v[k]["type_hint"] for k in "xyz"] == ["typing.List[int]", "list", "Unknown"] and not v["x"]["is_collection"] and not v["y"]["is_collection"]


def test_summary(spark):
    rows = [("p", 0, "a.py", source(FIB)), ("p", 1, ".tox/b.py", "def g(): pass\n"), ("q", 0, "c.py", "x = 1\n")]
    files = files_from(spark.createDataFrame(rows, "project string, ordinal long, path string, content string"))
    projects = spark.createDataFrame([("p",), ("q",), ("none",)], "project string")
    got = {r.project: r for r in complexity_summary(projects, function_complexity(parse_files(files))).collect()}
    assert (got["p"].total_functions, got["p"].average_confidence, got["p"].high_complexity_count) == (1, 0.6, 1)
    assert got["p"].high_complexity_functions[0].name == "f" and len(got["p"].high_complexity_functions[0].reasoning) == 3
    assert got["q"].total_functions == got["none"].total_functions == 0


def test_one_function(spark):
    from siltscope.operators.extract import analyze_function

    text = "def a(xs: list):\n    return sorted(xs)\n\ndef b(n):\n    return b(n - 1) + b(n - 2)\n"
    assert analyze_function(text)["time_complexity"] == "O(n log n)"
    got = analyze_function(text, "b", spark)
    assert (got["time_complexity"], got["recursion_type"], got["line"], round(got["confidence"], 9)) == ("O(2^n)", "binary", 4, 0.5)
    with pytest.raises(ValueError):
        analyze_function("x = 1", spark=spark)
