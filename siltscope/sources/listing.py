"""Python files of a project folder as rows: project, ordinal, path, content, in_complexity_scope, read_error.

Spark's own file sources skip names that begin with "_" or "."; these hold much of a Python project, so tasks list the folders, a
project in one, and pass names on as they find them; after an exchange others read the files. The driver sees only the roots.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltscope.session import ship

# Names of folders that no scan enters, and of those that only the complexity analysis leaves out.
SKIPPED = frozenset((".git", "__pycache__", ".venv", "venv", "node_modules", ".pytest_cache", "dist", "build"))
SKIPPED_BY_COMPLEXITY = frozenset((".tox", ".eggs"))
FILES = "project string, ordinal long, path string, content string, in_complexity_scope boolean, read_error string"


def list_python_files(root: str, order: str = "sorted") -> list[str]:
    """Paths below root of the *.py files, a folder's files before its sub-folders. order: "sorted", or "walk" as the system has it.

    A root that is a file has none; one that doesn't exist is an error.
    """
    if not os.path.exists(root):
        raise FileNotFoundError(f"Path '{root}' does not exist.")
    return list(walk_python_files(os.path.realpath(root), order))


def walk_python_files(root: str, order: str) -> Iterator[str]:
    for folder, inner, names in os.walk(root):
        inner[:] = [d for d in inner if d not in SKIPPED]
        if order == "sorted":
            inner.sort()
            names.sort()
        yield from (os.path.relpath(os.path.join(folder, n), root) for n in names if n.endswith(".py"))


def in_complexity_scope(path: str) -> bool:
    return not SKIPPED_BY_COMPLEXITY.intersection(path.split("/")[:-1])


def read_text(path: str) -> tuple[str | None, str | None]:
    """(content, None), or (None, what went wrong). Strict UTF-8; line ends become \\n; a byte order mark stays."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read(), None
    except (OSError, UnicodeDecodeError) as e:
        return None, f"{type(e).__name__}: {e}"


def source_files(spark: SparkSession, roots: str | list[str], order: str = "sorted", files_per_task: int = 500) -> DataFrame:
    """The files of one or more project folders; the folders must be mounted where the workers run. project is the resolved path."""
    from pyspark.sql import functions as F

    ship(spark)
    roots = [roots] if isinstance(roots, str) else list(roots)
    for r in roots:
        if not os.path.exists(r):
            raise FileNotFoundError(f"Path '{r}' does not exist.")

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda root, start, paths: pa.RecordBatch.from_pydict({"project": pa.array([root] * len(paths)), "ordinal": pa.array(range(start, start + len(paths)), pa.int64()), "path": pa.array(paths, pa.string())})
        for b in batches:
            for root in b.column("project").to_pylist():
                start, paths = 0, []
                for p in walk_python_files(root, order):
                    paths.append(p)
                    if len(paths) == 1000:
                        yield row(root, start, paths)
                        start, paths = start + 1000, []
                if paths:
                    yield row(root, start, paths)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                got = [read_text(f"{r}/{p}") for r, p in zip(part.column("project").to_pylist(), part.column("path").to_pylist())]
                scope = [in_complexity_scope(p) for p in part.column("path").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("project"), part.column("ordinal"), part.column("path"), pa.array([c for c, _ in got], pa.string()), pa.array(scope), pa.array([e for _, e in got], pa.string())], names=[f.split()[0] for f in FILES.split(", ")])

    projects = spark.createDataFrame([(os.path.realpath(r),) for r in roots], "project string").repartition(len(roots) or 1)
    listed = projects.mapInArrow(listing, "project string, ordinal long, path string")
    return listed.repartition("project", F.floor(F.col("ordinal") / files_per_task)).mapInArrow(read, FILES)


def files_from(df: DataFrame) -> DataFrame:
    """Any DataFrame with project, ordinal, path and content as source files."""
    from pyspark.sql import functions as F

    has = set(df.columns)
    skipped = [F.contains(F.concat(F.lit("/"), "path"), F.lit(f"/{x}/")) for x in sorted(SKIPPED_BY_COMPLEXITY)]
    scope = F.col("in_complexity_scope") if "in_complexity_scope" in has else ~reduce(or_, skipped)
    error = F.col("read_error") if "read_error" in has else F.when(F.col("content").isNull(), "null content")
    return df.select("project", F.col("ordinal").cast("long").alias("ordinal"), "path", "content", scope.alias("in_complexity_scope"), error.alias("read_error"))
