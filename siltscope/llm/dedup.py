"""Operator 2: removal of repeated byte strings, with suffix orders built by external induced sorting.

A byte goes if a string of `width` bytes that covers it starts anywhere else, in the same or another document. No suffix order over
the whole corpus is needed; equal windows of `width` bytes are brought together first:

1. Each window has an anchor: the leftmost string of `gram` bytes in it whose hash is least. Equal windows have equal anchors at equal
   places. A run of starts with one anchor, with the bytes its windows cover, is a segment; the anchor's hash is its key. A
   scan lists each document's segments: key, SHA-256 of the bytes (its first 128 bits), place. It carries no text. Equal neighbours, as in runs of
   one character, are one entry with a count.
2. Keys that occur once go. Equal segments are made one with a count (partial aggregation first: a hot passage is a row from each
   task). All starts of a segment that occurs twice are repeats. Left to decide are segments that occur once, beside others of their key.
3. The texts with such keys are fetched, one copy of each, and their segments cut into strips of at most `strip` starts at fixed
   distances from the anchor. All windows of a strip share a core: the bytes that lie in each of them. Cores that occur once go, and
   a core with one variant (the few bytes to its left and right) has nothing to sort.
4. Strips with the same core are written as strings of symbols: the bytes on the left, one symbol that stands for the core, the
   bytes on the right. They are dealt by core into shards, and a shard is sorted, block by block of whole cores, by suffixes.py: external
   induced sorting, with common prefixes counted in bytes, in bounded memory whatever the shard's or a core's size. A window holds its core, so
   no two blocks have one in common; a shard's time is in proportion to its symbols, but for cores larger than a block. Suffixes that share `width` bytes with a neighbour are repeats.
5. A hot core (over `most` variants) is split before it is sorted: its strips are halved, and each half has a longer core. A strip of
   one start is all core. So no task gets all strips around a passage that a third of the documents holds; the method stays the same.
6. The repeated starts return to the texts by segment; the bytes they cover are cut.

Joins on keys that may be hot have two plain tables as their sides, so that adaptive execution can split them.

Defined cases: null and empty texts, and those shorter than the width, lose nothing; all copies of a text lose the same; equal rows
are copies like any others; doc_id may be null; an empty table gives no rows; texts of any length are taken in blocks, and a run of one character of any
length is one entry; columns of any other name are kept by remove_repeats(), whose own get names that are free. Removed runs end
anywhere: what is left is bytes, and remove_repeats() leaves a character whole if only some of its bytes are covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscope.llm.common import documents, free_names, give_back, id_and_text, slices
from siltscope.llm.suffixes import Store, order_suffixes, run_ends
from siltscope.session import cut, discard, ship

WIDTH, STRIP = 200, 32
GRAM = WIDTH - 4 * STRIP + 1  # an anchor is at most 127 bytes into its window: four strips
SEPARATOR = 256  # the symbol between strings; bytes come before it, cores after it
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hashes of all strings of gram bytes."""
    base = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    power, length, out, have = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if gram & length:
            out = power if out is None else out[: len(power) - have] * base(length) + power[have:] if len(out) > len(power) - have else out * base(length) + power[have : have + len(out)]
            have += length
        length *= 2
        if length > gram:
            break
        half = length // 2
        power = power[:-half] * base(half) + power[half:]
    out = out[: len(data) - gram + 1].copy()
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def segments(data: bytes, width: int = WIDTH, gram: int = GRAM, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, anchor, first start, last start) of a text's segments, block by block. Anchors are told apart by 43 bits and their place."""
    w, raw = width - gram + 1, np.frombuffer(data, np.uint8)
    for at in range(0, len(data) - width + 1, block):
        part = raw[at : at + block + width - 1]
        h = gram_hashes(part, gram)
        low = sliding_min(h & np.uint64(~0x1FFFFF & (1 << 64) - 1) | np.arange(len(h), dtype=np.uint64), w)  # of equal ones, the leftmost
        anchor = (low & np.uint64(0x1FFFFF)).astype(np.int64)
        cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first, last = np.concatenate(([0], cuts)), np.concatenate((cuts - 1, [len(low) - 1]))
        anchor = anchor[first]
        yield h[anchor], anchor + at, first + at, last + at


def merged(data: bytes, key: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which segments stay, how many each stands for): neighbours with equal bytes at equal distances become one."""
    m = len(key)
    step, same = np.diff(first), np.diff(last - first) == 0
    same &= (key[1:] == key[:-1]) & (step == (last - first + 1)[:-1])
    stay, n = np.ones(m, bool), np.ones(m, np.int64)
    for at in np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)) == 1).tolist():
        end = at + 1
        rest = np.flatnonzero(~same[at:])
        end = at + int(rest[0]) if len(rest) else m - 1  # the run is at .. end
        p = int(step[at])
        if data[first[at] : last[end] + width - p] == data[first[at] + p : last[end] + width]:  # periodic: all are equal
            stay[at + 1 : end + 1] = False
            n[at] = end - at + 1
    return stay, n


def covered(runs: list[tuple[int, int]], size: int, width: int) -> np.ndarray:
    """Bytes covered by the windows that start in the given runs."""
    step, at = np.zeros(size + 1, np.int32), np.array(runs, np.int64).reshape(-1, 2)
    np.add.at(step, at[:, 0], 1)
    np.add.at(step, at[:, 1] + width, -1)
    return np.cumsum(step[:-1], dtype=np.int32) > 0


def digest128(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def _arrays(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def _longs(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols.values()], names=list(cols))


def _pairs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return x[:, 0], x[:, 1]


def list_segments(keyed: DataFrame, width: int, gram: int) -> DataFrame:
    """digest and arrays key, s1, s2 (the segment's digest), place (first << 16 | starts - 1 << 8 | anchor - first), n of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "s1", "s2", "place", "n"], [np.int64] * 4 + [np.int32]
        for b in batches:
            for part in slices(b, "text", 1 << 20):
                digest, cols = [], [[] for _ in names]
                for d, text in zip(part.column("digest").to_pylist(), part.column("text")):
                    data = text.as_py().encode()
                    got = []
                    for key, anchor, first, last in segments(data, width, gram):
                        stay, n = merged(data, key, first, last, width)
                        key, anchor, first, last, n = (x[stay] for x in (key, anchor, first, last, n))
                        s1, s2 = _pairs([digest128(data[i : j + width]) for i, j in zip(first.tolist(), last.tolist())])
                        got.append((key.view(np.int64), s1, s2, first << 16 | last - first << 8 | anchor - first, n))
                    if got:
                        digest.append(d)
                        for into, x in zip(cols, zip(*got)):
                            into.append(np.concatenate(x))
                lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))) for x, t in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), *lists], names=["digest", *names])
        give_back()

    return keyed.mapInArrow(scan, "digest binary, key array<long>, s1 array<long>, s2 array<long>, place array<long>, n array<int>")


SEGMENT = ["key", "s1", "s2"]
CORE, SUB = ["c1", "c2"], ["u1", "u2"]
STRIPS = "key long, s1 long, s2 long, n int, base long, c1 long, c2 long, u1 long, u2 long, left binary, right binary"


def strips_of(fetched: DataFrame, width: int, strip: int) -> DataFrame:
    """The strips of wanted segments (text, want): base is where in the segment the core begins."""
    ship(fetched.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, want in zip(b.column("text"), b.column("want").to_pylist()):
                data, rows, core, sub = text.as_py().encode(), [], [], []
                for x in want:
                    f, more, off = x["place"] >> 16, x["place"] >> 8 & 255, x["place"] & 255
                    a = f + off
                    for lo in range((off - more) // strip * strip, off + 1, strip):
                        least, most = max(lo, off - more), min(lo + strip - 1, off)  # how far the anchor is from the strip's starts
                        c, e = a - lo, a - lo - strip + 1 + width
                        rows.append((x["key"], x["s1"], x["s2"], x["n"], off - lo, data[a - most : c], data[e : a - least + width]))
                        core.append(digest128(data[c:e]))
                        sub.append(digest128(bytes([most - lo]) + data[a - most : a - least + width]))
                    if len(rows) > 2000:
                        yield _strips(rows, core, sub)
                        rows, core, sub = [], [], []
                if rows:
                    yield _strips(rows, core, sub)

    return fetched.mapInArrow(run, STRIPS)


def _strips(rows: list[tuple], core: list[bytes], sub: list[bytes]) -> pa.RecordBatch:
    key, s1, s2, n, base, left, right = zip(*rows)
    cols = [pa.array(x, pa.int64()) for x in (key, s1, s2)] + [pa.array(n, pa.int32()), pa.array(base, pa.int64())]
    cols += [pa.array(x) for x in (*_pairs(core), *_pairs(sub))] + [pa.array(x, pa.binary()) for x in (left, right)]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in STRIPS.split(", ")])


def halved(strips: DataFrame, strip: int) -> DataFrame:
    """Strips of at most `strip` starts as strips of half as many: the core grows by what all windows of a half share."""
    ship(strips.sparkSession)
    h = strip // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, core, sub = [], [], []
            for x in b.to_pylist():
                left, right = x["left"], x["right"]
                least, most = strip - 1 - len(right), len(left)
                old = x["c1"].to_bytes(8, "little", signed=True) + x["c2"].to_bytes(8, "little", signed=True)
                halves = []
                if least < h:
                    halves.append((0, left[most - min(most, h - 1) :], b"", right[:h], right[h:]))
                if most >= h:
                    halves.append((h, left[: most - h], left[most - h :], b"", right[: h - 1 - max(least - h, 0)]))
                for lo, new_left, grown_left, grown_right, new_right in halves:
                    c = digest128(bytes([h, lo > 0]) + old + grown_left + grown_right)
                    rows.append((x["key"], x["s1"], x["s2"], x["n"], x["base"] - lo, new_left, new_right))
                    core.append(c)
                    sub.append(digest128(c + bytes([len(new_left)]) + new_left + new_right))
            if rows:
                yield _strips(rows, core, sub)

    return strips.mapInArrow(run, STRIPS)


class CoreBlock:
    """Strips of some cores, sorted by core, written as strings of symbols; only strings of one core can have a window in common."""

    def __init__(self, store: Store):
        self.store, self.strings, self.texts = store, store.file(), store.file()  # of each string: u1, u2, where it begins, starts, whether it counts twice
        self.n = self.cores = 0

    def add(self, b: pa.RecordBatch, fresh: np.ndarray) -> None:
        """fresh: whether a row is the first of its core."""
        left, right = b.column("left").to_pylist(), b.column("right").to_pylist()
        ids = self.cores + np.cumsum(fresh) - 1
        self.cores += int(fresh.sum())
        size_l, size_r = np.array([*map(len, left)], np.int64), np.array([*map(len, right)], np.int64)
        total = size_l + size_r + 2
        at = np.cumsum(total) - total
        symbols = np.full(int(total.sum()), SEPARATOR, np.int32)
        for bits, size, skip in ((left, size_l, at), (right, size_r, at + size_l + 1)):
            into = np.repeat(skip - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            symbols[into] = np.frombuffer(b"".join(bits), np.uint8)
        symbols[at + size_l] = SEPARATOR + 1 + ids
        self.texts.write(symbols.tobytes())
        self.strings.write(np.stack([np.asarray(b.column("u1")), np.asarray(b.column("u2")), self.n + at, size_l + size_r, np.asarray(b.column("twice").cast(pa.int64()))], 1).tobytes())
        self.n += len(symbols)

    def repeats(self, width: int, core_bytes: int) -> Iterator[pa.RecordBatch]:
        store = self.store
        self.texts.flush()
        self.strings.flush()
        t, rows_of = np.memmap(self.texts, np.int32, "r"), np.memmap(self.strings, "<i8", "r").reshape(-1, 5)
        weight = store.array(SEPARATOR + 1 + self.cores, np.uint8, 1)
        weight[SEPARATOR + 1 :] = core_bytes
        again = store.array(self.n, np.uint8)
        before = [-1]

        def emit(pos: np.ndarray, common: np.ndarray, _) -> None:
            far = np.flatnonzero(common >= width)
            again[pos[far]] = 1
            again[np.where(far > 0, pos[far - 1], before[0])] = 1
            before[0] = int(pos[-1])

        order_suffixes(t, store, width, emit, weight)
        step = max(1, store.chunk // 16)
        for i in range(0, len(rows_of), step):
            u1, u2, begin, starts, twice = np.array(rows_of[i : i + step]).T
            starts = starts + core_bytes - width + 1
            of = np.repeat(np.arange(len(begin)), starts)
            place = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
            hit = np.flatnonzero((again[begin[of] + place] > 0) | (twice[of] > 0))
            of, place = of[hit], place[hit]
            end = np.ones(len(of), bool)
            end[:-1] = (np.diff(of) != 0) | (np.diff(place) != 1)
            head = np.ones(len(of), bool)
            head[1:] = end[:-1]
            yield _longs({"u1": u1[of[head]], "u2": u2[of[head]], "first": place[head], "last": place[end]})


def sort_shard(rows: Iterator[pa.RecordBatch], width: int, core_bytes: int, store: Store, block: int | None = None) -> Iterator[pa.RecordBatch]:
    """u1, u2, first, last: the repeated starts (counted from the string's begin) of strips c1, c2, u1, u2, left, right, twice, sorted by core.

    One suffix order holds all strings of some cores: cores are added until it has `block` symbols (by default two spans of the store, so that
    its queues are on disk), as the deeper levels of a longer one take more time a symbol. A core is never cut, whatever its size.
    """
    most, held, last = block or 2 * store.span, CoreBlock(store), None
    for b in rows:
        if not b.num_rows:
            continue
        core = np.stack([np.asarray(b.column(c)) for c in CORE], 1)
        fresh = np.ones(len(core), bool)
        fresh[1:] = (core[1:] != core[:-1]).any(axis=1)
        fresh[0] = last is None or (core[0] != last).any()
        last, first = core[-1], np.flatnonzero(fresh)
        size = np.asarray(pc.add(pc.binary_length(b.column("left")), pc.binary_length(b.column("right"))), np.int64) + 2
        ahead, at = np.cumsum(size) - size, 0
        while len(full := first[(first >= at) & (held.n + ahead[first] - ahead[at] >= most)]):
            if full[0] > at:
                held.add(b.slice(at, full[0] - at), fresh[at : full[0]])
            yield from held.repeats(width, core_bytes)
            held, at = CoreBlock(store), int(full[0])
        held.add(b.slice(at), fresh[at:])
    if held.n:
        yield from held.repeats(width, core_bytes)


def repeats_of(strips: DataFrame, width: int, strip: int, most: int, shard_symbols: int, memory: int) -> DataFrame:
    """SEGMENT, first, last: runs of repeated starts, counted from the segment's first, found in strips."""
    spark, found = strips.sparkSession, None
    while True:
        variants = cut(strips.groupBy(*CORE, *SUB).agg(F.sum("n").alias("times")), "variants")
        cores = variants.groupBy(*CORE).agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("variants"), F.min("times").alias("least"))
        cores = cut(cores.where("total > 1").select(*CORE, "variants", "least"), "cores")
        judged = cut(strips.join(cores, CORE), "judged")
        span = F.octet_length("left")
        base = F.col("base") - span
        starts = span + F.octet_length("right") - (strip - 1)  # minus one
        rows = [judged.where("variants = 1 or least > 1").select(*SEGMENT, base.alias("first"), (base + starts).alias("last"))]
        todo = judged.where("variants > 1 and least = 1")
        cold = todo.where(F.col("variants") <= most)
        once = cold.groupBy(*SUB).agg(*[F.first(c).alias(c) for c in (*CORE, "left", "right")], (F.sum("n") > 1).alias("twice"))
        once = cut(once, "strings")
        total = once.agg(F.sum(F.octet_length("left") + F.octet_length("right") + 2)).first()[0] or 0
        if total:
            # large shards, but no fewer than keep the cluster busy, in whole rounds of its cores
            shards = int(max(total // shard_symbols + 1, min(2 * spark.sparkContext.defaultParallelism, (total >> 20) + 1)))

            def sort(batches: Iterator[pa.RecordBatch], core_bytes: int = width - strip + 1) -> Iterator[pa.RecordBatch]:
                give_back()
                with Store(memory) as store:
                    yield from sort_shard(batches, width, core_bytes, store)

            sorted_ = once.repartition(shards, *CORE).sortWithinPartitions(*CORE).mapInArrow(sort, "u1 long, u2 long, first long, last long")
            hits = cut(sorted_, "repeated-strips")
            rows.append(cold.select(*SEGMENT, *SUB, base.alias("base")).join(hits, SUB).select(*SEGMENT, (F.col("base") + F.col("first")).alias("first"), (F.col("base") + F.col("last")).alias("last")))
        for r in rows:
            found = r if found is None else found.unionByName(r)
        hot = todo.where(F.col("variants") > most)
        if strip == 1 or not hot.limit(1).count():
            return found
        strips, strip = cut(halved(hot.select(*strips.columns), strip), "halves"), strip // 2


def repeats(texts: DataFrame, width: int = WIDTH, strip: int = STRIP, most: int = 100_000, shard_symbols: int = 1 << 28, memory: int = 96 << 20) -> DataFrame:
    """digest (SHA-256 of the text) and runs (array of struct first, last: starts of repeated windows) of texts with repeats.

    texts: a column text without nulls, a row for each document. strip: a power of two; a fourth of the starts around an anchor.
    most: variants of a core above which its strips are halved. memory: bytes for one shard's sorting.
    """
    ship(texts.sparkSession)
    keyed = texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    listed = cut(list_segments(keyed, width, width - 4 * strip + 1).select(F.monotonically_increasing_id().alias("row"), "*"), "segments")
    each = listed.select("row", F.explode(F.arrays_zip(*SEGMENT, "place", "n")).alias("x")).select("row", "x.*")
    again = cut(each.groupBy("key").agg(F.sum("n").alias("times")).where("times > 1").select("key"), "repeated-keys")
    kept = cut(each.join(again, "key"), "repeated-segments")
    rows = cut(listed.select("row", "digest"), "rows")
    discard(listed)  # most of it are keys that occur once
    distinct = cut(kept.groupBy(*SEGMENT).agg(F.sum("n").alias("n"), F.first("row").alias("row"), F.first("place").alias("place")), "distinct-segments")
    keys = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("variants"), F.min("n").alias("least"))
    keys = cut(keys.where("variants > 1 and least = 1").select("key"), "open-keys")
    todo = distinct.join(keys, "key").select(*SEGMENT, F.least("n", F.lit(2)).cast("int").alias("n"), "row", "place")
    wanted = todo.groupBy("row").agg(F.collect_list(F.struct(*SEGMENT, "n", "place")).alias("want"))
    wanted = wanted.join(rows, "row").groupBy("digest").agg(F.flatten(F.collect_list("want")).alias("want"))
    strips = cut(strips_of(distinct_texts(keyed).join(wanted, "digest").select("text", "want"), width, strip), "strips")
    found = repeats_of(strips, width, strip, most, shard_symbols, memory)
    run = F.struct("first", "last")
    some = found.groupBy(*SEGMENT).agg(F.collect_list(run).alias("runs"))
    whole = distinct.where("n > 1").select(*SEGMENT, F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("runs"))
    decided = cut(some.join(whole.select(*SEGMENT), SEGMENT, "left_anti").unionByName(whole), "decided")
    at, size = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255) + 1
    all_of = F.array(F.struct(at.alias("first"), (at + size * F.col("n") - 1).alias("last")))
    moved = F.transform("runs", lambda x: F.struct((x["first"] + at).alias("first"), (x["last"] + at).alias("last")))
    back = kept.join(decided, SEGMENT).select("row", F.coalesce(moved, all_of).alias("runs"))
    by_row = back.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    # copies of a text have the same runs: one row stands for all
    return by_row.join(rows, "row").groupBy("digest").agg(F.first("runs").alias("runs"))


def distinct_texts(keyed: DataFrame, most: int = 1_000_000) -> DataFrame:
    """digest, text with each text once; a task sends a text once, before the rows are dealt by digest."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            keep = [i for i, d in enumerate(b.column("digest").to_pylist()) if not (d in seen or seen.add(d))]
            if len(seen) > most:
                seen.clear()
            yield b.take(pa.array(keep, pa.int64()))

    return keyed.mapInArrow(first, "digest binary, text string").groupBy("digest").agg(F.first("text").alias("text"))


def strip_texts(texts: DataFrame, found: DataFrame, width: int, whole_characters: bool) -> DataFrame:
    """digest, n_removed, n_spans, kept (bytes) of the distinct texts in found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("digest", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
        for b in batches:
            for part in slices(b, "text"):
                out = []
                for digest, text, runs in zip(part.column("digest").to_pylist(), part.column("text"), part.column("runs").to_pylist()):
                    data = text.as_py().encode()
                    gone = covered([(r["first"], r["last"]) for r in runs], len(data), width)
                    raw = np.frombuffer(data, np.uint8)
                    if whole_characters:  # a character goes if all its bytes do
                        head = np.flatnonzero((raw & 0xC0) != 0x80)
                        gone = np.repeat(np.logical_and.reduceat(gone, head), np.diff(np.append(head, len(raw))))
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((digest, int(gone.sum()), spans, raw[~gone].tobytes()))
                yield _arrays(out, fields)

    keyed = texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    return distinct_texts(keyed).join(found, "digest").select("digest", "text", "runs").mapInArrow(run, "digest binary, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without the repeated strings in their column text; whole characters only. Null texts stay null."""
    digest, kept = free_names(docs, "digest", "kept")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    new = strip_texts(texts, repeats(texts, width), width, True).select(F.col("digest").alias(digest), F.decode("kept", "UTF-8").alias(kept))
    new = cut(new, "stripped")
    out = docs.withColumn(digest, F.unhex(F.sha2("text", 256))).join(new, digest, "left")
    return out.select(*[F.coalesce(kept, "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = id_and_text(documents(spark, sf_dir))
    texts = docs.select("text")
    kept_hash = F.sha2("kept", 256)
    new = strip_texts(texts, repeats(texts), WIDTH, False).select("digest", "n_removed", "n_spans", kept_hash.alias("kept_sha256"))
    new = cut(new, "stripped")
    own = F.sha2("text", 256)
    keyed = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(own).alias("digest"))
    zero = F.lit(0).cast("long")
    out = keyed.join(new, "digest", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"))


#: DuckDB SQL of op2_suffix_dedup: all windows of 200 bytes by their digests.
OP2_SQL = """
WITH t AS (SELECT row_number() OVER () AS uid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT uid, doc_id, h, length(h) // 2 AS n FROM t),
w AS (SELECT uid, i, md5_number(substring(h, 2 * i + 1, 400)) AS g FROM (SELECT uid, h, unnest(range(n - 199)) AS i FROM d WHERE n >= 200)),
many AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
starts AS (SELECT uid, i FROM w SEMI JOIN many USING (g)),
edges AS (SELECT *, i - lag(i) OVER (PARTITION BY uid ORDER BY i) AS gap FROM starts),
spans AS (SELECT uid, min(i) AS s, max(i) + 200 AS e FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY i) AS run FROM edges) GROUP BY uid, run),
cuts AS (SELECT uid, s, e, coalesce(lag(e) OVER (PARTITION BY uid ORDER BY s), 0) AS before, row_number() OVER (PARTITION BY uid ORDER BY s DESC) = 1 AS final FROM spans),
kept AS (SELECT c.uid, sum(e - s)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans,
    string_agg(substring(h, 2 * before + 1, 2 * (s - before)) || CASE WHEN final THEN substring(h, 2 * e + 1) ELSE '' END, '' ORDER BY s) AS k FROM cuts c JOIN d USING (uid) GROUP BY c.uid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (uid)
"""
