"""Operator 10: byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Long texts are cut in one pass, and their chunks are dealt out by an exchange before any is split:
each is a row of its own, split into pre-tokens and encoded by itself, in a task of its own. A chunk's first boundaries may be
wrong, as it may begin inside a pre-token, and its last one may be, as the chunk ends there. Matching goes left to right and has no
memory, so once two neighbours share a boundary in their overlap, all later ones agree. Stitching joins ids, not texts: it takes
the left chunk's ids up to the first shared boundary and the right chunk's from there. Only where an overlap has none (a run as long as
the overlap) is the text split and encoded anew from the last certain boundary, over twice as many chunks each time that fails.
Pieces are encoded by merges by rank, lowest first and leftmost among equals, with a bounded memo of pieces. Decoding concatenates
the tokens' bytes.

Defined cases: null and empty texts have no ids and empty digests; equal and null doc_ids stay separate rows; texts of any length
are whole; an empty table gives no rows; other columns are ignored, whatever their names. Ids are as those of the rank file, without
special tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscope.llm.common import documents, id_and_text
from siltscope.llm.tokens import WHITE, Memo
from siltscope.session import ship


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a rank file: a base64 token and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token. A heap of adjacent pairs over a linked list: n log n for long pieces."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # end[i]: where the part that begins at i ends; 0 when it is gone
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != e:  # one of the two has merged meanwhile
            continue
        end[i], end[mid] = e, 0
        if e < n:
            prev[e] = i
            if (r := ranks.get(piece[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def latin_pattern() -> str:
    """The usual pattern for texts whose code points are all below 0x250, with classes that the faster re module knows."""
    kinds = {k: "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    letter, number = ("".join(f"\\u{ord(c):04x}" for c in kinds[k]) for k in "LN")
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


class Part:
    """A chunk's pre-tokens: where each ends in the text, how many ids there are up to it, and the ids."""

    def __init__(self, start: int, stop: int, ends: np.ndarray, counts: np.ndarray, ids: bytes):
        self.start, self.stop, self.ends, self.counts, self.ids = start, stop, ends, counts, ids

    def ids_between(self, a: int, b: int) -> bytes:
        """Ids of the pre-tokens between two of its boundaries."""
        at = lambda x: 0 if x == self.start else int(self.counts[np.searchsorted(self.ends, x)])
        return self.ids[4 * at(a) : 4 * at(b)]


def stitch(parts: list[Part], n: int, text_of, encode) -> Iterator[bytes]:
    """Ids of a text of n characters from its chunks, in order. text_of(i, j, base): the text of chunks i .. j from base on;
    encode(text, base) gives the Part of a text that begins at a boundary."""
    now, sure, k = parts[0], 0, 1  # ids up to the boundary `sure` are given; from there, those of `now` are right but for its last pre-token
    home, failed = 0, 0  # home: the chunk that holds `sure`
    while k < len(parts):
        right = parts[k]
        mine = now.ends[(now.ends > sure) & (now.ends < now.stop) & (now.ends >= right.start)]
        shared = np.intersect1d(mine, np.append(right.start, right.ends), assume_unique=False)
        if sure >= right.start and (sure == right.start or sure in right.ends):
            shared = np.array([sure])
        if len(shared):
            at = int(shared[0])
            yield now.ids_between(sure, at)
            now, sure, home, failed, k = right, at, k, 0, k + 1
            continue
        last = min(len(parts) - 1, k + (1 << failed) - 1)
        now, failed, k = encode(text_of(home, last, sure), sure), failed + 1, last + 1
    yield now.ids_between(sure, n)


class Codec:
    """encode(text) -> ids, decode(ids) -> bytes, by a rank file."""

    def __init__(self, path: str, pattern: str, most_pieces: int = 900_000, chunk: int = 1 << 15, overlap: int = 1 << 9):
        import re

        self.ranks, self.chunk, self.overlap = read_ranks(path), chunk, overlap
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.ids = Memo(lambda w: np.array(merge(w.encode(), self.ranks), "<u4").tobytes(), most_pieces)
        self.full = regex.compile(pattern)
        from siltscope.llm.tokens import BYTE_LEVEL

        self.latin = re.compile(latin_pattern()) if pattern == BYTE_LEVEL else None
        self.beyond = re.compile("[^\\u0000-\\u024f]")

    def pieces(self, text: str) -> list[str]:
        return self.latin.findall(text) if self.latin and not self.beyond.search(text) else self.full.findall(text)

    def chunks(self, n: int) -> list[tuple[int, int]]:
        return [(s, min(n, s + self.chunk + self.overlap)) for s in range(0, max(1, n), self.chunk)]

    def part(self, text: str, start: int) -> Part:
        """A chunk that begins at `start`, split and encoded."""
        pieces = self.pieces(text)
        got = [self.ids[x] for x in pieces]
        return Part(start, start + len(text), start + np.cumsum([len(x) for x in pieces], dtype=np.int64), np.cumsum([len(x) >> 2 for x in got], dtype=np.int64), b"".join(got))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(text) <= self.chunk:
            return b"".join([self.ids[x] for x in self.pieces(text)])
        cuts = self.chunks(len(text))
        return b"".join(stitch([self.part(text[s:e], s) for s, e in cuts], len(text), lambda i, j, base: text[base : cuts[j][1]], self.part))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, long_chars: int = 1 << 15) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of each document."""
    return _encode(docs, ranks, pattern, long_chars, "ids binary", lambda c, ids: (ids,), [pa.binary()])


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and bytes of each row of encode()."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.decode(x.as_py()) for x in b.column("ids")], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def _encode(docs: DataFrame, ranks: str, pattern: str, long_chars: int, fields: str, of, kinds: list) -> DataFrame:
    """A scan encodes the texts of one chunk. Longer ones take a second scan: their chunks are dealt out, split and encoded, and their ids stitched."""
    ship(docs.sparkSession)
    texts, names = id_and_text(docs), [x.split()[0] for x in fields.split(", ")]

    def batch(who, got) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), *(pa.array([x[k] for x in got], t) for k, t in enumerate(kinds))], names=["doc_id", *names])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for b in batches:
            yield batch(b.column("doc_id"), [of(c, c.encode(x.as_py())) for x in b.column("text")])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for b in batches:
            for uid, who, text in zip(b.column("uid"), b.column("doc_id"), b.column("text")):
                text = text.as_py()
                cuts = c.chunks(len(text))
                for i in range(0, len(cuts), 64):
                    few = cuts[i : i + 64]
                    yield pa.RecordBatch.from_pydict({"uid": pa.array([uid.as_py()] * len(few), pa.int64()), "doc_id": pa.array([who.as_py()] * len(few), pa.int64()), "k": pa.array(range(i, i + len(few)), pa.int32()), "part": pa.array([text[s:e] for s, e in few])})

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for b in batches:
            got = [c.part(x.as_py(), 0) for x in b.column("part")]
            cols = [pa.array([f(x) for x in got], pa.binary()) for f in (lambda x: x.ends.astype("<i4").tobytes(), lambda x: x.counts.astype("<i4").tobytes(), lambda x: x.ids)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("uid", "doc_id", "k", "part")), *cols], names=["uid", "doc_id", "k", "part", "ends", "counts", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        c, rows = codec(ranks, pattern), table.sort_by("k").to_pylist()
        ints = lambda x: np.frombuffer(x, "<i4").astype(np.int64)
        parts = [Part(s, s + len(r["part"]), s + ints(r["ends"]), ints(r["counts"]), r["ids"]) for r in rows for s in [r["k"] * c.chunk]]

        def text_of(i: int, j: int, base: int) -> str:
            return "".join([*(r["part"][: c.chunk] for r in rows[i:j]), rows[j]["part"]])[base - i * c.chunk :]

        return pa.Table.from_batches([batch([rows[0]["doc_id"]], [of(c, b"".join(stitch(parts, parts[-1].stop, text_of, c.part)))])])

    short = texts.where(F.length("text") <= long_chars).mapInArrow(whole, f"doc_id long, {fields}")
    long = texts.where(F.length("text") > long_chars).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    dealt = long.mapInArrow(cut_up, "uid long, doc_id long, k int, part string").repartition("uid", "k")
    stitched = dealt.mapInArrow(chunked, "uid long, doc_id long, k int, part string, ends binary, counts binary, ids binary").groupBy("uid").applyInArrow(joined, f"doc_id long, {fields}")
    return short.unionByName(stitched)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    def digests(c: Codec, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    kinds = [pa.int64(), pa.string(), pa.string()]
    return _encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 1 << 15, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests, kinds)
