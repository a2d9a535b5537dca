"""Operator 8: packing of documents into sequences by bounded-space online best-fit.

Documents become pieces of at most `capacity` tokens; only longer ones are cut, and then all pieces but the first are full. A full
piece is a sequence of its own and touches no open bin. The others go to a stream of bins: a fixed number of bins is open, a bitset has
a bit for each amount of free space that some open bin has, and the smallest set bit not below the piece's length names the best fit. If
no open bin fits and all are in use, the fullest closes. Each task packs its own stream.

What is still open at a task's end is not wasted: those bins (open_bins at most from each task) become items of a next round (their
fill is the length), in which the bins of `fan_in` tasks meet in one. A bin that closes there is done; only those still open go on, again a
bounded number from each task. So no task of any round sees more than fan_in times as many items as bins are open. Rounds end with one
task, or when one joins few of its items.

Sequence ids are (round, task, counter), so no global numbering is needed.

Defined cases: null and empty texts are a document of the end id alone; repeated rows are packed each for itself; doc_id may be
null; an empty table gives no rows; other columns of pieces are kept, under any name but sequence_id and offset, which are
replaced; ties between equal free space go to the bin filled last; a text of any length is cut into any number of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscope.llm.common import documents, free_names, id_and_text
from siltscope.llm.tokens import encoder
from siltscope.session import cut, ship

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Bins:
    """Open bins by free space. put() returns the key of the bin, its fill before, and the key of a bin that closed or None."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.free = 0  # bit f: some open bin has f free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.next = 0

    def _take(self, free: int) -> int:
        key = self.by_free[free].pop()
        if not self.by_free[free]:
            self.free &= ~(1 << free)
        self.open -= 1
        return key

    def put(self, length: int) -> tuple[int, int, int | None]:
        if length == self.capacity:
            self.next += 1
            return self.next - 1, 0, self.next - 1
        fits, closed = self.free >> length << length, None
        if fits:
            free = (fits & -fits).bit_length() - 1
            key = self._take(free)
        else:
            if self.open >= self.most:
                closed = self._take((self.free & -self.free).bit_length() - 1)  # the least free space: the fullest
            key, free, self.next = self.next, self.capacity, self.next + 1
        if left := free - length:
            self.by_free[left].append(key)
            self.free |= 1 << left
            self.open += 1
        else:
            closed = key if closed is None else closed  # a full bin needs no note: nothing fits it again
        return key, self.capacity - free, closed

    def rest(self) -> list[tuple[int, int]]:
        """(key, fill) of the bins still open."""
        return [(k, self.capacity - f) for f, keys in enumerate(self.by_free) for k in keys]


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first may be shorter, the others are full."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Encode documents and cut them: doc_id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for who, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = enc.ids(text.as_py()) + end
                out += [(who, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut_lengths(len(ids) // 4, capacity))]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = 2048, open_bins: int = 512, fan_in: int = 32) -> DataFrame:
    """pieces (with a column length, 1 to capacity) plus sequence_id and offset.

    The rows must not change from one reading to the next, as those of a table do; pack() numbers them within their partitions.
    """
    ship(pieces.sparkSession)
    pieces = pieces.drop("sequence_id", "offset")
    fields, (bin_, at) = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema], free_names(pieces, "bin", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = Bins(capacity, open_bins), TaskContext.get().partitionId() << 32
        for b in batches:
            got = [bins.put(n) for n in b.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base | k for k, _, _ in got], pa.int64()), pa.array([o for _, o, _ in got], pa.int64())], names=[*b.schema.names, bin_, at])
        left = bins.rest()  # marks of the open bins follow, as rows with only length, bin and at < 0
        n = len(left)
        if n:
            columns = {f.name: pa.nulls(n, f.type) for f in b.schema} | {"length": pa.array([f for _, f in left], b.schema.field("length").type)}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array([base | k for k, _ in left], pa.int64()), pa.array([-1] * n, pa.int64())], names=[*columns, bin_, at])

    placed = cut(pieces.mapInArrow(run, ", ".join([*fields, f"`{bin_}` long", f"`{at}` long"])), "packed")
    leaf, root, shift = free_names(placed, "leaf", "root", "shift")
    moved = merge_open(placed.where(F.col(at) < 0).select(F.col(bin_).alias("item"), F.col("length").cast("long").alias("length")), capacity, open_bins, fan_in)
    moved = moved.select(F.col("leaf").alias(leaf), F.col("root").alias(root), F.col("shift").alias(shift))
    out = placed.where(F.col(at) >= 0).join(moved, F.col(bin_) == F.col(leaf), "left")
    return out.select(*[F.col(f"`{f.name}`") for f in pieces.schema], F.coalesce(root, F.col(bin_) * 2).alias("sequence_id"), (F.col(at) + F.coalesce(shift, F.lit(0))).cast("long").alias("offset"))


def merge_open(items: DataFrame, capacity: int, open_bins: int, fan_in: int, least_gain: float = 1 / 64) -> DataFrame:
    """leaf -> (root, shift): the bin in which an open bin (item, length) ended, and where in it."""
    items = cut(items.select("item", "length"), "open")
    where = cut(items.select(F.col("item").alias("leaf"), F.col("item").alias("root"), F.lit(0).cast("long").alias("shift")), "bins")
    tasks, level = items.select(F.shiftright("item", 32).alias("t")).distinct().count(), 1
    while tasks > 1:
        groups, round_ = -(-tasks // fan_in), level << 56

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            """A row for each item: the bin it went to. kept: the bin is still open, and has this fill; one row of a bin says so."""
            bins, base = Bins(capacity, open_bins), round_ | (key[0].as_py() << 32)
            order = table.sort_by([("length", "descending"), ("item", "ascending")])
            got = [bins.put(n) for n in order.column("length").to_pylist()]
            left, kept = dict(bins.rest()), []
            for k, _, _ in got:
                kept.append(left.pop(k, None))
            return pa.table({"item": order.column("item"), "to": pa.array([base | k for k, _, _ in got], pa.int64()), "at": pa.array([o for _, o, _ in got], pa.int64()), "kept": pa.array(kept, pa.int64())})

        group = F.pmod(F.shiftright("item", 32).bitwiseAND(0xFFFFFF), F.lit(groups))  # by the task that made the bin
        step = cut(items.withColumn("g", group.cast("long")).groupBy("g").applyInArrow(run, "item long, to long, at long, kept long"), "merged")
        moves = step.select(F.col("item").alias("root"), "to", "at")
        where = cut(where.join(moves, "root", "left").select("leaf", F.coalesce("to", "root").alias("root"), (F.col("shift") + F.coalesce("at", F.lit(0))).alias("shift")), "bins")
        n, bins = step.agg(F.count(F.lit(1)), F.sum((F.col("at") == 0).cast("long"))).first()
        items = step.where("kept is not null").select(F.col("to").alias("item"), F.col("kept").alias("length"))
        tasks, level = groups, level + 1
        if n - bins < least_gain * n:
            break
    return where.withColumn("root", F.col("root") * 2 + 1)


def op8_best_fit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = cut(pieces_of(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048), "pieces")
    return pack(pieces)
