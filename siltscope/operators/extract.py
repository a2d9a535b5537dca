"""What one pass of Python's parser tells about a file: its imports, and facts about each function in it.

Everything here is plain Python over one file and uses explicit stacks, so deep nesting is no error. Facts are counts and lists;
all judgement on them (classes, confidence, reasons) is made later by column expressions.
"""

from __future__ import annotations

import ast
import keyword
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from siltscope.functions.scalars import line_count
from siltscope.session import ship

# Cost of a call by the called name.
TIME_COST = {
    "O(1)": ["len", "append", "pop", "add", "get", "setdefault", "clear"],
    "O(n log n)": ["sort", "sorted"],
    "O(n)": ["reverse", "copy", "list", "set", "dict", "sum", "max", "min", "any", "all", "index", "count", "remove", "insert", "insort", "insort_left", "insort_right", "heapify"],
    "O(k)": ["extend", "update"],
    "O(log n)": ["bisect_left", "bisect_right", "heappush", "heappop"],
    "O(n log k)": ["nlargest", "nsmallest"],
}
# Space that a call takes by the called name.
SPACE_COST = {
    "O(n)": ["sorted", "list", "set", "dict", "copy", "deepcopy"],
    "O(k)": ["slice"],
}
# Kinds of collection by the annotation's name.
COLLECTIONS = {
    "list": ["List", "list", "Sequence", "Iterable", "Collection"],
    "dict": ["Dict", "dict", "Mapping"],
    "set": ["Set", "set"],
    "tuple": ["Tuple", "tuple"],
}
# Decorators that keep results.
MEMO = frozenset(("lru_cache", "cache", "memoize", "cached"))

_by_name = lambda table: {name: value for value, names in table.items() for name in names}
_time, _space, _kind = map(_by_name, (TIME_COST, SPACE_COST, COLLECTIONS))

_variable = pa.struct([("name", pa.string()), ("source", pa.string()), ("type_hint", pa.string()), ("is_collection", pa.bool_()), ("collection_type", pa.string()), ("is_input_dependent", pa.bool_()), ("constant_size", pa.int32())])
_loop = pa.struct([("loop_type", pa.string()), ("iterator_var", pa.string()), ("iterable_source", pa.string()), ("estimated_iterations", pa.string()), ("is_input_dependent", pa.bool_()), ("has_early_exit", pa.bool_()), ("nested_depth", pa.int32())])
_pair = lambda a, b: pa.list_(pa.struct([(a, pa.string()), (b, pa.string())]))
_function = pa.struct([
    ("walk_idx", pa.int32()), ("name", pa.string()), ("line", pa.int32()), ("n_params", pa.int32()), ("n_typed", pa.int32()), ("uses_memo", pa.bool_()), ("max_loop_depth", pa.int32()), ("recursive_calls", pa.int32()), ("has_early_exit", pa.bool_()),
    ("loops", pa.list_(_loop)), ("expensive_ops", _pair("op", "cost")), ("space_allocs", _pair("kind", "size")), ("variables", pa.list_(_variable)),
])
_pairs = lambda a, b: f"array<struct<{a}:string,{b}:string>>"
FUNCTION = (
    "struct<walk_idx:int,name:string,line:int,n_params:int,n_typed:int,uses_memo:boolean,max_loop_depth:int,recursive_calls:int,has_early_exit:boolean,"
    "loops:array<struct<loop_type:string,iterator_var:string,iterable_source:string,estimated_iterations:string,is_input_dependent:boolean,has_early_exit:boolean,nested_depth:int>>,"
    f"expensive_ops:{_pairs('op', 'cost')},space_allocs:{_pairs('kind', 'size')},"
    "variables:array<struct<name:string,source:string,type_hint:string,is_collection:boolean,collection_type:string,is_input_dependent:boolean,constant_size:int>>>"
)


def preorder(roots: list[ast.AST]) -> Iterator[ast.AST]:
    """Nodes of the trees, a node before its children, in the order of the source."""
    stack = roots[::-1]
    while stack:
        node = stack.pop()
        yield node
        stack += [*ast.iter_child_nodes(node)][::-1]


def called(call: ast.Call) -> str | None:
    """The last name of what is called."""
    return getattr(call.func, "id", None) or getattr(call.func, "attr", None) if isinstance(call.func, (ast.Name, ast.Attribute)) else None


def described(node: ast.AST) -> str:
    """How an iterable reads: a.b.c, f(...), x[...]; "unknown" for the rest."""
    tail = ""
    while True:
        match node:
            case ast.Name():
                return node.id + tail
            case ast.Attribute():
                tail, node = f".{node.attr}{tail}", node.value
            case ast.Subscript():
                tail, node = f"[...]{tail}", node.value
            case ast.Call():
                return f"{called(node)}(...){tail}"
            case _:
                return f"unknown{tail}"


def annotation(node: ast.AST) -> str:
    match node:
        case ast.Name():
            return node.id
        case ast.Constant():
            return str(node.value)
        case ast.Attribute():
            return f"{annotation(node.value)}.{node.attr}"
        case ast.Subscript():
            inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
            return f"{annotation(node.value)}[{', '.join(map(annotation, inner))}]"
    return "Unknown"


def collection_kind(node: ast.AST) -> str | None:
    while isinstance(node, ast.Subscript):
        node = node.value
    return _kind.get(node.id) if isinstance(node, ast.Name) else None


class Flow:
    """Variables of a function, and whether they come from its parameters."""

    def __init__(self, function):
        self.known: dict[str, dict] = {}
        for a in function.args.args:
            kind = a.annotation and collection_kind(a.annotation)
            self.set(a.arg, "parameter", True, annotation(a.annotation) if a.annotation else None, kind)
        self.parameters = frozenset(self.known)
        self.origin = {p: {p} for p in self.known}
        self.typed = sum(bool(v["type_hint"]) for v in self.known.values())
        for node in preorder(function.body):
            if isinstance(node, ast.Assign):
                for target in node.targets:
                    if isinstance(target, ast.Name):
                        self.assign(target.id, "assignment", node.value, self.literal_kind(node.value), len(node.value.elts) if isinstance(node.value, ast.List) else None)
            elif isinstance(node, ast.For) and isinstance(node.target, ast.Name):
                self.assign(node.target.id, "loop", node.iter)

    def set(self, name, source, dependent, hint=None, kind=None, size=None) -> None:
        self.known[name] = {"name": name, "source": source, "type_hint": hint, "is_collection": kind is not None, "collection_type": kind, "is_input_dependent": dependent, "constant_size": size}

    def assign(self, name, source, value, kind=None, size=None) -> None:
        origin = self.origins(value)
        self.set(name, source, any(o in self.parameters or o in self.known and self.known[o]["is_input_dependent"] for o in origin), None, kind, size)
        self.origin[name] = origin

    @staticmethod
    def literal_kind(node) -> str | None:
        name = type(node).__name__.removesuffix("Comp").lower()
        return name if name in ("list", "dict", "set") else None

    def origins(self, value) -> set[str]:
        """Names that a value is made of, with what those came from."""
        out, stack = set(), [value]
        while stack:
            match stack.pop():
                case ast.Name(id=name):
                    out |= {name} | self.origin.get(name, set())
                case ast.BinOp(left=a, right=b):
                    stack += [a, b]
                case ast.Call(func=f, args=args):
                    stack += args
                    if isinstance(f, ast.Name):
                        out.add(f"call:{f.id}")
                case ast.Subscript(value=v) | ast.Attribute(value=v):
                    stack.append(v)
                case ast.List(elts=e) | ast.Tuple(elts=e) | ast.Set(elts=e):
                    stack += e
                case ast.ListComp(generators=g):
                    stack += [x.iter for x in g]
        return out

    def dependent(self, node) -> bool:
        """Whether an expression depends on the parameters, by what is known at the function's end."""
        stack = [node]
        while stack:
            match stack.pop():
                case ast.Name(id=name):
                    if name in self.known and self.known[name]["is_input_dependent"]:
                        return True
                case ast.Attribute(value=v) | ast.Subscript(value=v):
                    stack.append(v)
                case ast.Call(args=args):
                    stack += args
        return False


def loop_of(node: ast.For | ast.While, flow: Flow) -> dict:
    """What a loop iterates over, and how often as far as can be told."""
    source, times, dependent, var = "condition", "n", True, ""
    if isinstance(node, ast.While):
        halves = any(isinstance(s, ast.Assign) and isinstance(s.value, ast.BinOp) and isinstance(s.value.op, ast.FloorDiv) for s in node.body)
        if isinstance(node.test, ast.Compare) and halves:
            source, times = "binary_search", "log n"
    else:
        var, over = getattr(node.target, "id", "unknown") if isinstance(node.target, ast.Name) else "unknown", node.iter
        name, args = (called(over), over.args) if isinstance(over, ast.Call) else (None, [])
        if name == "range":
            source = "range(...)"
            if len(args) == 1:
                match args[0]:
                    case ast.Constant(value=v):
                        source, times, dependent = f"range({v})", "constant", False
                    case ast.Name(id=v):
                        source, dependent = f"range({v})", flow.dependent(args[0])
                    case ast.Call(args=[inner, *_]) if called(args[0]) == "len":
                        source, dependent = f"range(len({described(inner)}))", flow.dependent(inner)
        else:
            inner = args[0] if name in ("enumerate", "zip") and args else over
            source, dependent = described(inner), flow.dependent(inner)
    return {"loop_type": "while" if isinstance(node, ast.While) else "for", "iterator_var": var, "iterable_source": source, "estimated_iterations": times, "is_input_dependent": dependent, "has_early_exit": any(isinstance(x, (ast.Break, ast.Return)) for x in ast.walk(node))}


def keeps_results(function) -> bool:
    for d in function.decorator_list:
        name = d.id if isinstance(d, ast.Name) else called(d) if isinstance(d, ast.Call) else None
        if name in MEMO:
            return True
    return False


def analyze_function(source: str, name: str | None = None, spark=None) -> dict:
    """The classes of one function of a source text (the first, or the first of that name), as operators.complexity gives them."""
    from pyspark.sql import SparkSession

    from siltscope.operators.complexity import function_complexity

    spark = spark or SparkSession.getActiveSession()
    status, _, functions = parse(source)
    wanted = [f for f in functions if name is None or f["name"] == name][:1]
    if not wanted:
        raise ValueError(f"no function{f' {name}' if name else ''} in the text ({status})")
    row = spark.createDataFrame([("", 0, "", True, wanted)], f"project string, ordinal long, path string, in_complexity_scope boolean, functions array<{FUNCTION}>")
    return function_complexity(row).first().asDict(recursive=True)


def function_facts(function: ast.FunctionDef | ast.AsyncFunctionDef, walk_idx: int = 0) -> dict:
    """One row of FUNCTION."""
    flow = Flow(function)
    loops, ops, allocs, deepest, own_calls = [], [], [], 0, 0
    stack = [(s, 0) for s in reversed(function.body)]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, (ast.For, ast.While)):
            depth += 1
            loops.append(loop_of(node, flow) | {"nested_depth": depth})
        elif isinstance(node, (ast.ListComp, ast.DictComp)):
            many = len(node.generators)
            depth += many
            allocs.append({"kind": "list_comp" if isinstance(node, ast.ListComp) else "dict_comp", "size": "O(n)" if many == 1 else f"O(n^{many})"})
        elif isinstance(node, ast.Call) and (name := called(node)):
            own_calls += name == function.name
            if name in _time:
                ops.append({"op": name, "cost": _time[name]})
            if name in _space:
                allocs.append({"kind": name, "size": _space[name]})
        deepest = max(deepest, depth)
        stack += [(c, depth) for c in ast.iter_child_nodes(node)][::-1]
    return {
        "walk_idx": walk_idx, "name": function.name, "line": function.lineno, "n_params": len(flow.parameters), "n_typed": flow.typed, "uses_memo": keeps_results(function), "max_loop_depth": deepest, "recursive_calls": own_calls,
        "has_early_exit": any(x["has_early_exit"] for x in loops), "loops": loops, "expensive_ops": ops, "space_allocs": allocs, "variables": list(flow.known.values()),
    }


def imported(tree: ast.AST) -> list[str]:
    """Imported names, each once: modules, and module.name of from-imports; aliases and purely relative imports don't count."""
    out: dict[str, None] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out |= dict.fromkeys(a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            out |= dict.fromkeys([node.module, *(f"{node.module}.{a.name}" for a in node.names)])
    return list(out)


def parse(content: str | None) -> tuple[str, list[str], list[dict]]:
    """(status, imports, functions). status: ok, syntax_error (no facts), aborted (the parser gave up), unreadable."""
    if content is None:
        return "unreadable", [], []
    import warnings

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content)
    except SyntaxError:
        return "syntax_error", [], []
    except (RecursionError, MemoryError, ValueError):
        return "aborted", [], []
    nodes = (n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))
    try:
        return "ok", imported(tree), [function_facts(n, k) for k, n in enumerate(nodes)]
    except RecursionError:  # an annotation nested beyond reason
        return "aborted", imported(tree), []


def parse_files(files: DataFrame) -> DataFrame:
    """project, ordinal, path, text_lc, line_count, in_complexity_scope, scan_status, imports, functions: one parse of each file."""
    ship(files.sparkSession)
    names = ["project", "ordinal", "path", "content", "in_complexity_scope", "read_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                got = [parse(c) for c in part.column("content").to_pylist()]
                extra = [pa.array([s for s, _, _ in got], pa.string()), pa.array([i for _, i, _ in got], pa.list_(pa.string())), pa.array([f for _, _, f in got], pa.list_(_function))]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*names, "scan_status", "imports", "functions"])

    parsed = files.select(*names).mapInArrow(run, f"project string, ordinal long, path string, content string, in_complexity_scope boolean, read_error string, scan_status string, imports array<string>, functions array<{FUNCTION}>")
    return parsed.select("project", "ordinal", "path", F.lower("content").alias("text_lc"), line_count("content").alias("line_count"), "in_complexity_scope", "scan_status", "imports", "functions")


# Words that mean something to the parser or to the rules above; no function with such a name shares its facts.
RESERVED = frozenset((*keyword.kwlist, *keyword.softkwlist, *_time, *_space, *_kind, *MEMO, "range", "len", "enumerate", "zip", "unknown", "print", "exec", "__debug__", "__future__", "barry_as_FLUFL"))
# Shapes kept by a worker, the longest, and their characters in all; files
# whose groups are made together at most, the characters of their texts, and those of the groups' own texts.
SHAPES, LONGEST, KEPT = 8192, 8192, 1 << 23
WINDOW, HELD, FRESH = 1 << 16, 1 << 24, 1 << 20

_def = re.compile(r"\bdef[ \t]+([A-Za-z_][A-Za-z0-9_]*)")
_blurred = re.compile(r"""["'\\]|[\w\0]\0|\0\w|[0-9]\.\0""")


def shape_of(content: str) -> tuple[str, str] | None:
    """(the text with its first function's name taken out, that name). Texts of one shape differ in nothing but the name of that function, wherever
    it stands as a whole identifier; so they parse alike. None: the text is long, or that name is a reserved word."""
    m = _def.search(content) if len(content) <= LONGEST else None
    name = m and m[1]
    return None if not name or name in RESERVED or "\0" in content else (content.replace(name, "\0"), name)


def shared_facts(shape: str, name: str, facts: tuple[str, list[str], list[dict]]) -> tuple[str, list[str], list[dict]] | None:
    """The facts of one text of a shape as those of all: functions of the name taken out get None for it. None: the shape has quotes, backslashes or
    other than ASCII characters, the name touches others of a word or a number, or facts hold the name elsewhere."""
    if not shape.isascii() or _blurred.search(shape):
        return None
    status, imports, functions = facts
    functions = [f | {"name": None if f["name"] == name else f["name"]} for f in functions]
    return None if name in repr((imports, functions)) else (status, imports, functions)


class Facts:
    """Facts of texts in a worker: (status, imports, functions, number of lines). Each shape is parsed once, other texts one by one."""

    def __init__(self):
        self.shapes, self.chars = {}, 0

    def of(self, content: str | None) -> tuple[tuple, str | None]:
        """The facts (the same object for all texts of a shape), and the name of the functions that have None there."""
        shape, name = content is not None and shape_of(content) or (None, None)
        known = self.shapes.get(shape) if shape else False
        if known:
            return known, name
        facts = parse(content)
        lines = None if content is None else len(content.splitlines())
        if known is None:
            if len(self.shapes) >= SHAPES or self.chars > KEPT:
                self.shapes, self.chars = {}, 0
            shared = shared_facts(shape, name, facts)
            self.chars += len(shape)
            self.shapes[shape] = known = shared and (*shared, lines)
            if known:
                return known, name
            self.shapes[shape] = False
        return (*facts, lines), None


def parse_groups(files: DataFrame, keep: list[str], functions: bool = True, words: list[list[str]] | None = None, names: list[list[str]] | None = None) -> DataFrame:
    """scan_status, line_count, imports, functions, by_keyword, by_import, members: a row for each group of files of a task whose facts are the same.

    members has the columns `keep` of each file and `name`: that of the functions whose name is null. A file is in one group, so what holds for a
    group is found once for its files; files that share no facts are groups of one. functions: false leaves those empty. words and names: lower-case
    keywords and imports of each pattern; by_keyword and by_import are the places of the patterns that a file shows itself.
    """
    ship(files.sparkSession)
    columns = [*keep, "content"]
    kinds = dict(files.dtypes)
    members = f"array<struct<{','.join(f'{c}:{kinds[c]}' for c in keep)},name:string>>"
    words, names = words or [], names or []
    plain = not any(c.isdigit() for ws in words for w in ws for c in w)
    digits = re.compile("[0-9]+")

    def shown(content: str | None) -> tuple[int, ...]:
        text = (content or "").lower()
        return () if content is None else tuple(k for k, ws in enumerate(words) if any(w in text for w in ws))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Facts(), {}
        rows, parts, ids, called_, groups, fresh, held = {}, [], [], [], [], 0, 0

        def group(content: str | None) -> tuple[int, str | None]:
            nonlocal fresh, held
            facts, name = known.of(content)
            found = ()
            if words and not name:
                found = shown(content)
            elif words:
                # where no keyword has a digit, none lies across a digit of the name: only what else is in it counts
                key = id(facts), digits.sub("0", name) if plain else name
                if key not in seen:
                    if len(seen) >= SHAPES:
                        seen.clear()
                    seen[key] = facts, shown(content)  # with the facts, so that no other object gets their id
                found = seen[key][1]
            at = rows.get((id(facts), found)) if name else None
            if at is None:
                at = len(groups)
                groups.append((facts, found))
                if name:
                    rows[(id(facts), found)] = at
                fresh += len(content or "")
            held += len(content or "")
            return at, name

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, parts, ids, called_, groups, fresh, held
            if not ids:
                return
            place = np.asarray(ids)
            order = pa.array(np.argsort(place, kind="stable"))
            ends = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(groups))))).astype(np.int32)
            kept = pa.Table.from_batches(parts).combine_chunks()
            fields = [*((c, kept.column(c).combine_chunks()) for c in keep), ("name", pa.array(called_, pa.string()))]
            taken = [(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).take(order) for _, x in fields]
            inner = pa.StructArray.from_arrays(taken, names=[c for c, _ in fields])
            imported_by = lambda f: [k for k, ws in enumerate(names) if any(w in i.lower() for i in f[1] for w in ws)]
            out = [
                pa.array([f[0] for f, _ in groups], pa.string()), pa.array([f[3] for f, _ in groups], pa.int64()), pa.array([f[1] for f, _ in groups], pa.list_(pa.string())),
                pa.array([f[2] if functions else [] for f, _ in groups], pa.list_(_function)), pa.array([list(k) for _, k in groups], pa.list_(pa.int32())),
                pa.array([imported_by(f) for f, _ in groups], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(ends), inner),
            ]
            rows, parts, ids, called_, groups, fresh, held = {}, [], [], [], [], 0, 0
            whole = pa.RecordBatch.from_arrays(out, names=["scan_status", "line_count", "imports", "functions", "by_keyword", "by_import", "members"])
            for k in range(0, whole.num_rows, 256):
                yield whole.slice(k, 256)

        for b in batches:
            texts = b.column("content").to_pylist()
            start = 0
            for k, content in enumerate(texts):
                at, name = group(content)
                ids.append(at)
                called_.append(name)
                if fresh >= FRESH or held >= HELD or len(ids) >= WINDOW:
                    parts.append(b.slice(start, k + 1 - start).select(keep))
                    start = k + 1
                    yield from flush()
            if start < len(texts):
                parts.append(b.slice(start).select(keep))
        yield from flush()

    return files.select(*columns).mapInArrow(run, f"scan_status string, line_count long, imports array<string>, functions array<{FUNCTION}>, by_keyword array<int>, by_import array<int>, members {members}")


@udtf(returnType=f"status string, imports array<string>, functions array<{FUNCTION}>")
class ParsePython:
    """SQL: SELECT ... FROM files, LATERAL parse_python(content)."""

    def eval(self, content: str):
        yield parse(content)
