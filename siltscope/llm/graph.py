"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscope.session import cut, ship


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def link(self, a: int, b: int) -> bool:
        a, b = sorted((self.root(a), self.root(b)))
        self.up.setdefault(a, a)
        self.up[b] = a
        return a != b

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]


def contract(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Edges (u, v) with each partition's edges replaced by stars of its own components, `most` nodes at a time."""
    ship(edges.sparkSession)

    def out(f: Forest) -> pa.RecordBatch:
        got = f.edges()
        return pa.RecordBatch.from_pydict({"u": pa.array([a for a, _ in got], pa.int64()), "v": pa.array([b for _, b in got], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest()
        for b in batches:
            for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                f.link(x, y)
            if len(f.up) > most:
                yield out(f)
                f = Forest()
        yield out(f)

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node -> root for every node of edges (u, v: long, no nulls): the smallest node that it reaches.

    A step is a grouped minimum and a join; a star's hub is a hot key of that join only, both of whose sides are plain tables, so that
    adaptive execution can split it. Rounds grow with the logarithm of the longest path; the table of each round is written to the shared folder.
    """
    now = cut(contract(edges.where("u <> v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = cut(small, "edges")
        # settled when every node has one edge and no root is a child
        children = small.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        settled = children.where("n > 1").limit(1).count() == 0 and small.select(F.col("v").alias("u")).distinct().join(children, "u", "left_semi").limit(1).count() == 0
        now = small
        if settled:
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
