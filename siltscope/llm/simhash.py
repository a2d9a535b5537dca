"""Operator 5: SimHash near-duplicates by bit-sliced comparison.

Fingerprints: A-Z in lower case, words [^\\x20\\x09-\\x0D]+, 4-word shingles (repeats included, joined by one space; fewer words: all
of them; none: fingerprint zero), XXH64 with seed 42; a bit is 1 if it is set in over half the hashes.

All pairs of distinct fingerprints at most `radius` bits apart are found exactly. Of radius + e blocks of bits, e are equal in such a
pair, so each choice of e blocks is a table whose buckets hold candidates; e is the least that makes buckets small for the number of
fingerprints there is (5 tables of one block up to 2 ** 18, 15 of two of 6 up to 2 ** 27, 35 of three of 7 up to 2 ** 33, and so on). A bucket is
compared in vertical layout: its fingerprints are stored once as bit planes, a word for each bit and 64 candidates. A fingerprint
is compared with a word of candidates plane by plane: the plane, inverted where its own bit is set, is added to carry-save counters,
so 64 distances grow at once. After each eight planes, words whose candidates have all passed the radius are abandoned. Only a
bucket's spanning links leave the task. A bucket with too many fingerprints is not compared: those fingerprints, once each, go through
the tables of two more equal blocks, which again lose no pair; with four bits left free, no bucket has over 16. Links are then
joined to components.

Defined cases: null and empty texts, and those of white space only, have fingerprint zero and are linked like any other; equal
texts have equal fingerprints and are one node; a null doc_id gets the component of its fingerprint, and is no component's id
unless all its members are null; an empty table gives no rows; other columns are ignored by near_duplicates() and kept, under any
name, by drop_near_duplicates(); ties for the one that stays go to the smallest doc_id, then the least SHA-256 of the text, then any
of the equal rows; texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltscope.llm.common import documents, free_names, give_back, id_and_text
from siltscope.llm.graph import Forest, components
from siltscope.session import cut, ship

ALL = (1 << 64) - 1


def fingerprint(text: str, width: int = 4) -> int:
    import xxhash

    words = text.encode().lower().split()  # of bytes: only ASCII letters change, and only ASCII white space parts
    n = len(words)
    if not n:
        return 0
    if n <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.r_[0, ends[: n - width]].tolist()
        of = xxhash.xxh64_intdigest
        hashes = [of(line[s : e - 1], 42) for s, e in zip(starts, ends[width - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), width) for x in b.column("text")], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])
        give_back()

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def planes(words: np.ndarray) -> np.ndarray:
    """words: fingerprints, 64 to a row. A bit plane for each row and bit: bit i of planes[b, row] is bit b of the row's i-th fingerprint."""
    out = np.empty((64, len(words)), np.uint64)
    for r in range(0, len(words), 1024):
        bits = np.unpackbits(words[r : r + 1024].view("u1").reshape(-1, 64, 8), axis=2, bitorder="little")  # row, candidate, bit
        out[:, r : r + 1024] = np.packbits(bits, axis=1, bitorder="little").transpose(2, 0, 1).copy().view(np.uint64)[:, :, 0]
    return out


def near(fp: np.ndarray, plane: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a query (a place in fp) and a word of candidates (a column of plane): the pairs with any candidate at most
    radius (below 8) bits off, and a word with a bit for each such candidate."""
    alive, own = np.arange(len(query)), fp[query]
    one, two, four, over = (np.zeros(len(query), np.uint64) for _ in range(4))
    past = over
    for bit in range(64):
        x = plane[bit, word] ^ (np.uint64(0) - (own >> np.uint64(bit) & np.uint64(1)))
        c1 = one & x
        one = one ^ x
        c2 = two & c1
        two = two ^ c1
        over = over | (four & c2)
        four = four ^ c2
        if bit % 8 == 7:
            past = over
            for far in range(radius + 1, 8):  # the counts below 8 that are beyond the radius
                past = past | ((one if far & 1 else ~one) & (two if far & 2 else ~two) & (four if far & 4 else ~four))
            keep = np.flatnonzero(past != ALL)
            if len(keep) < len(alive):
                alive, own, word, one, two, four, over, past = (z[keep] for z in (alive, own, word, one, two, four, over, past))
            if not len(alive):
                break
    return alive, ~past


def near_pairs(fp: np.ndarray, size: np.ndarray, radius: int, at_once: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places a, places b) of the pairs in radius within each of the buckets that lie one after another in fp."""
    n_words = -(-size // 64)
    cost = np.cumsum(size * n_words)
    begin, at = np.cumsum(size) - size, 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + at_once, side="right")))
        m, w = size[at:stop], n_words[at:stop]
        skip = np.cumsum(w) - w  # words before each bucket
        of = np.repeat(np.arange(len(m)), m)
        within_ = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
        slot = skip[of] * 64 + within_
        padded, place = np.zeros(int(w.sum()) * 64, np.uint64), np.full(int(w.sum()) * 64, -1)
        padded[slot], place[slot] = fp[begin[at] : begin[at] + len(of)], begin[at] + np.arange(len(of))
        plane = planes(padded.reshape(-1, 64))
        # each fingerprint meets its own word of candidates and those after it
        first = within_ // 64
        n_pairs = w[of] - first
        query = np.repeat(np.arange(len(of)), n_pairs)
        word = np.arange(len(query)) - np.repeat(np.cumsum(n_pairs) - n_pairs, n_pairs) + (skip[of] + first)[query]
        for i in range(0, len(query), at_once):
            q, x = query[i : i + at_once], word[i : i + at_once]
            alive, found = near(padded[slot], plane, q, x, radius)
            for j in range(0, len(alive), at_once // 64):  # 64 pairs each at most
                few, bits = alive[j : j + at_once // 64], np.unpackbits(found[j : j + at_once // 64].view("u1").reshape(-1, 8), axis=1, bitorder="little")
                pair, bit = np.nonzero(bits)
                a, b = place[slot[q[few[pair]]]], place[x[few[pair]] * 64 + bit]
                real = b > a  # candidates that are no padding, each pair once
                yield a[real], b[real]
        at = stop


def block_masks(bits: list[int], blocks: int = 6, equal: int = 2) -> list[int]:
    """Masks of `equal` of `blocks` runs of the given bit places."""
    parts = [sum(1 << int(b) for b in x) for x in np.array_split(bits, min(blocks, len(bits)))]
    return [sum(x) for x in combinations(parts, min(equal, len(parts)))]


def equal_blocks(n: int, radius: int, small: int = 6) -> int:
    """How many blocks of bits to hold equal, so that n fingerprints make buckets of some 2 ** small."""
    e = 1
    while e < 64 - radius and (1 << (64 * e // (radius + e) + small)) < n:
        e += 1
    return e


def links(fps: DataFrame, radius: int = 4, most: int = 4096) -> DataFrame:
    """Edges u, v (longs) that join all distinct fingerprints `fp` at most radius bits apart into their components."""
    spark = fps.sparkSession
    ship(spark)
    equal = equal_blocks(fps.count(), radius)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, groups, held = Forest(), [], 0

        def flush():
            nonlocal held
            if groups:
                fp = np.concatenate(groups)
                for a, b in near_pairs(fp, np.array([len(g) for g in groups]), radius):
                    for x, y in zip(fp[a].view("i8").tolist(), fp[b].view("i8").tolist()):
                        forest.link(x, y)
                groups.clear()
                held = 0

        def bucket(fp: np.ndarray):
            nonlocal held
            groups.append(fp)
            held += len(fp)
            if held >= 1 << 16:
                flush()

        def rows(u, v):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v)], names=["u", "v"])

        key, group, size, big = None, [], 0, False
        for b in batches:
            fp, mask = (np.asarray(b.column(c)).view(np.uint64) for c in ("fp", "mask"))
            cut_at = np.flatnonzero(np.r_[True, (np.diff(mask) != 0) | (np.diff(fp & mask) != 0)])
            for s, e in zip(cut_at, [*cut_at[1:], len(fp)]):
                now = (int(mask[s]), int(fp[s] & mask[s]))
                if now != key:
                    if size > 1 and not big:
                        bucket(np.concatenate(group))
                    key, group, size, big = now, [], 0, False
                group.append(fp[s:e])
                size += e - s
                if size > max(most, 16):  # to be parted by more bits; the fingerprints pass through
                    big = True
                    x = np.concatenate(group).view("i8")
                    yield rows(x, [None] * len(x))
                    group = []
        if size > 1 and not big:
            bucket(np.concatenate(group))
        flush()
        got = forest.edges()
        yield rows([x for x, _ in got], [y for _, y in got])

    found = None
    while True:
        masks = block_masks(list(range(64)), radius + equal, equal)
        each = F.explode(F.split(F.lit(" ".join(str(m - (1 << 64) if m >> 63 else m) for m in masks)), " "))  # fixed by the bits, not by the data
        x = fps.select("fp", each.alias("mask")).select("fp", F.col("mask").cast("long").alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        got = cut(x.repartition("mask", "key").sortWithinPartitions("mask", "key").select("fp", "mask").mapInArrow(compare, "u long, v long"), "links")
        edges, hot = got.where("v is not null"), got.where("v is null").select(F.col("u").alias("fp"))
        found = edges if found is None else found.unionByName(edges)
        if equal >= 64 - radius or not hot.limit(1).count():
            return found
        fps, equal = cut(hot.distinct(), "hot"), min(64 - radius, equal + 2)


def roots(nodes: DataFrame, radius: int) -> DataFrame:
    """fp and root (a fingerprint of its component) of each row of nodes (distinct fp)."""
    root = components(links(nodes, radius))
    return cut(nodes.join(root, nodes.fp == root.node, "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    marked = cut(fingerprints(docs, width), "fingerprints")
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    named = nodes.join(roots(nodes, radius), "fp")
    named = cut(named, "named")
    least = cut(named.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    of_fp = cut(named.join(least, "root").select("fp", "component_id"), "component-ids")  # plain tables: hot keys can be split
    return marked.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id (null last, then by the text's SHA-256)."""
    id_, digest, row = free_names(docs, "__id", "__digest", "__row")
    who = [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.sha2(F.coalesce("text", F.lit("")), 256)]
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), width) for x in b.column("text")], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("digest"), pa.array(fp)], names=["id", "digest", "fp"])
        give_back()

    marked = docs.select(who[0].alias("id"), who[1].alias("digest"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "id long, digest string, fp long")
    marked = cut(marked, "fingerprints")
    nodes = cut(marked.groupBy("fp").agg(F.min(F.struct("id", "digest")).alias("first")), "nodes")
    stay = nodes.join(roots(nodes, radius), "fp").groupBy("root").agg(F.min("first").alias("x")).select(F.col("x.id").alias(id_), F.col("x.digest").alias(digest))
    held = docs.withColumns({id_: who[0], digest: who[1]}).join(cut(stay, "stay"), [id_, digest], "left_semi")
    # repeated rows share a key: one of them stays
    first = F.row_number().over(Window.partitionBy(id_, digest).orderBy(id_))
    return held.withColumn(row, first).where(F.col(row) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
