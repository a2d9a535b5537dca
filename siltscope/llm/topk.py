"""Operator 6: exact top-k inner products by columnar branch and bound.

Each component x becomes floor(256 * x), x as double; scores are integer inner products. All vectors are packed into blocks in
vertical layout (a dimension's values lie together), and so are the queries. Every block of queries first meets one block of
candidates, and each query's k-th score there is its first threshold everywhere; then it meets every block once, by an equi-join on
the block's number. Within a pair of blocks, scores accumulate one group of dimensions at a time, those of most mass first. What the
other dimensions can still add is at most the product of the two remaining norms (Cauchy-Schwarz); each query drops the candidates
whose bound is below its own k-th score. While over a fourth of the pairs are alive a group of dimensions is one product of the two blocks, without the
candidates that no query needs; after that each query goes on with its own survivors, compacted. The k best of each pair of blocks
are then ranked for each query.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without vec_id take no part; vectors of
different lengths are not compared; an empty vector scores 0 against its like; rows with equal vec_id are rows of their own (each
is the other's candidate, and each is a query if its id asks for it); ties go to the smaller vec_id; fewer candidates than k give
fewer rows; an empty table gives no rows; other columns are ignored, whatever their names; sums beyond 64 bits stop at the limits of a
long, and vectors with such numbers are compared without bounds, in whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltscope.session import cut, ship

BLOCK = "block int, dim int, n int, uids binary, ids binary, vertical binary"
LONG = (1 << 63) - 1


class Best:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, floor  # floor: a score that k candidates of each query reach, here or elsewhere
        self.score, self.id = np.full((queries, k), -np.inf), np.zeros((queries, k), np.int64)
        self.pairs = self.products = 0  # of a query and a candidate; the products of numbers that were made for them

    @property
    def least(self) -> np.ndarray:
        return self.score[:, -1] if self.floor is None else np.maximum(self.score[:, -1], self.floor)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(query)
        old_q, old_s, old_i = np.repeat(touched, self.k), self.score[touched].ravel(), self.id[touched].ravel()
        q, s, i = (np.concatenate(x) for x in ((query, old_q), (score, old_s), (ids, old_i)))
        order = np.lexsort((i, -s, q))
        q = q[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        kept = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[touched], self.id[touched] = s[kept].reshape(-1, self.k), i[kept].reshape(-1, self.k)


def best_of_blocks(q: np.ndarray, q_uids: np.ndarray, x: np.ndarray, x_uids: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None, step: int = 8, tile: int = 2048, few: int = 256) -> Best:
    """q: queries by dimension, x: dimension by candidate (vertical); both hold whole numbers as doubles, with sums below 2**53."""
    dims, best = len(x), Best(len(q), k, floor)
    by_mass = np.argsort(-np.square(q).sum(axis=0) * np.square(x).sum(axis=1), kind="stable")
    q, x = q[:, by_mass], x[by_mass]
    cuts = [*range(0, dims, step), dims] if dims else [0, 0]
    left_q, left_x = (np.sqrt(np.array([np.square(a[c:]).sum(axis=0) for c in cuts])) for a in (q.T, x))
    # tiles from large to small norms, so that good scores come early; the first is small
    order, at, width = np.argsort(-left_x[0], kind="stable"), 0, 256
    while at < len(order):
        here, at, width = order[at : at + width], at + width, tile
        part, part_left = np.ascontiguousarray(x[:, here]), left_x[:, here]
        for g in range(0, len(q), few):
            _tile(best, np.arange(g, min(g + few, len(q))), q, q_uids, left_q, part, part_left, x_uids[here], ids[here], cuts)
    return best


def _tile(best: Best, rows: np.ndarray, q, q_uids, left_q, x, left_x, x_uids, ids, cuts: list[int]) -> None:
    """Some queries against one tile of candidates."""
    over = lambda bound, least: bound * (1 + 1e-9) + 1e-6 >= least
    score, least, live = np.zeros((len(rows), len(ids))), best.least[rows], np.arange(len(ids))
    best.pairs += score.size
    for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
        alive = over(score + left_q[j, rows][:, None] * left_x[j, live], least[:, None])
        n = int(np.count_nonzero(alive))
        if 4 * n < alive.size and j:  # each query goes on by itself
            for i in np.flatnonzero(alive.any(axis=1)):
                mine = np.flatnonzero(alive[i])
                own, mine = score[i, mine], live[mine]
                for m in range(j, len(cuts) - 1):
                    keep = over(own + left_q[m, rows[i]] * left_x[m, mine], least[i])
                    own, mine = own[keep], mine[keep]
                    lo, hi = cuts[m], cuts[m + 1]
                    own = own + q[rows[i], lo:hi] @ x[lo:hi, mine]
                    best.products += len(mine) * (hi - lo)
                hit = np.flatnonzero((own >= least[i]) & (x_uids[mine] != q_uids[rows[i]]))
                if len(hit):
                    best.add(np.full(len(hit), rows[i]), own[hit], ids[mine[hit]])
            return
        needed = alive.any(axis=0)
        if not needed.all():
            live, score = live[needed], score[:, needed]
        if not len(live):
            return
        score += q[rows, a:b] @ x[a:b, live]
        best.products += score.size * (b - a)
    i, hit = np.nonzero((score >= least[:, None]) & (q_uids[rows][:, None] != x_uids[live]))
    if len(i):
        best.add(rows[i], score[i, hit], ids[live[hit]])


def best_exact(q, q_uids, x, x_uids, ids, k) -> list[tuple[int, int, int]]:
    """The same with numbers of any size, for vectors whose sums may pass 2**53: (query, id, score)."""
    out = []
    for j in range(len(q)):
        score = [max(-LONG - 1, min(LONG, int(s))) for s in q[j].astype(object) @ x.astype(object)] if len(x) else [0] * len(ids)
        found = sorted((-s, int(i)) for s, i, u in zip(score, ids, x_uids) if u != q_uids[j])[:k]
        out += [(j, i, -s) for s, i in found]
    return out


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """rows (uid, vec_id, v: array of longs) as `blocks` numbered blocks of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        by_dim: dict[int, list] = {}
        for b in batches:
            v = b.column("v")
            off, flat = np.asarray(v.offsets), np.asarray(v.values)
            size = np.diff(off)
            uid, vid = np.asarray(b.column("uid")), np.asarray(b.column("vec_id"))
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                by_dim.setdefault(int(d), []).append((uid[at], vid[at], flat[off[at][:, None] + np.arange(d)].reshape(len(at), d)))
        for d, parts in by_dim.items():
            uid, vid, m = (np.concatenate(x) for x in zip(*parts))
            cols = [pa.array([x], t) for x, t in ((TaskContext.get().partitionId(), pa.int32()), (d, pa.int32()), (len(uid), pa.int32()), (uid.tobytes(), pa.binary()), (vid.tobytes(), pa.binary()), (np.ascontiguousarray(m.T).tobytes(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "dim", "n", "uids", "ids", "vertical"])

    return rows.repartition(blocks).mapInArrow(run, BLOCK)


def top_k(vectors: DataFrame, is_query, k: int = 5, per_block: int = 8192, queries_per_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best. vectors: vec_id, embedding; is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    ship(spark)
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(finite).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(256 * e.cast("double")).cast("long")).alias("v"))
    rows = cut(rows, "vectors")  # uids are fixed here
    n, n_q = rows.count(), rows.where(is_query).count()
    blocks, q_blocks = max(1, -(-n // per_block)), max(1, -(-n_q // queries_per_block))
    data = cut(packed(rows, blocks), "blocks")  # blocks are fixed here
    names = ("n", "uids", "ids", "vertical")
    queries = cut(packed(rows.where(is_query), q_blocks).select(F.col("block").alias("q_block"), "dim", *[F.col(c).alias(f"q_{c}") for c in names]), "query-blocks")

    def best(r: dict, floor: np.ndarray | None) -> tuple[Best | None, tuple]:
        """The best of a pair of blocks: query (its place), id, score."""
        ints = lambda c: np.frombuffer(r[c], "<i8")
        q, m = ints("q_vertical").reshape(r["dim"], r["q_n"]).T, ints("vertical").reshape(r["dim"], r["n"])
        q_uids, uids, ids = ints("q_uids"), ints("uids"), ints("ids")
        high = lambda a: max((abs(int(a.max())), abs(int(a.min())))) if a.size else 0
        if high(q) * high(m) * max(1, r["dim"]) < 1 << 53:
            got = best_of_blocks(q.astype(float), q_uids, m.astype(float), uids, ids, k, floor)
            at = np.nonzero(got.score > -np.inf)
            return got, (at[0], got.id[at], got.score[at].astype(np.int64))
        return None, tuple(np.array(c, np.int64) for c in zip(*best_exact(q, q_uids, m, uids, ids, k))) or (np.zeros(0, np.int64),) * 3

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                got, _ = best(r, None)
                least = np.full(r["q_n"], -np.inf) if got is None else got.least
                yield pa.RecordBatch.from_pydict({"q_block": pa.array([r["q_block"]], pa.int32()), "dim": pa.array([r["dim"]], pa.int32()), "floor": pa.array([least.astype("<f8").tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                _, found = best(r, np.frombuffer(r["floor"], "<f8") if r["floor"] else None)
                q_uids, q_ids = (np.frombuffer(r[c], "<i8") for c in ("q_uids", "q_ids"))
                cols = [q_uids[found[0]], q_ids[found[0]], found[1], found[2]]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c), pa.int64()) for c in cols], names=["query", "query_id", "vec_id", "score"])

    first = data.groupBy("dim").agg(F.min("block").alias("block"))
    seeds = queries.join(data.join(first, ["dim", "block"]), "dim").mapInArrow(floors, "q_block int, dim int, floor binary")
    armed = queries.join(cut(seeds, "floors"), ["q_block", "dim"], "left")
    pairs = armed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(data, ["block", "dim"])
    found = pairs.mapInArrow(run, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


#: DuckDB SQL of op6_topk.
OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.uid <> c.uid AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
