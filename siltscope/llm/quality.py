"""Operator 9: quality rules, with repetition measured on suffix arrays.

The texts of a batch become one array of word numbers. In documents with a repeated 3-word window (no other has a repeat of three
words or more) the suffixes are sorted by prefix doubling, all documents at once; the ranks of each doubling level then give the
longest common prefix of neighbours in the suffix array. The intervals of that prefix array (runs of neighbours that share so many
words, and beyond which fewer are shared) are the repeats that no word more to the right extends; those whose occurrences do not
all have the same word before them no word to the left extends either: these are the maximal repeats. The spans of the maximal
repeats of min_words words and more are united. A document passes if the union covers at most max_covered of its words and the
longest repeat has at most max_longest words.

Base columns (of the words [^\\x20\\x09-\\x0D]+): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. base_failed: fewer
than 50 words, or more than half of them in repeated 3-word windows.

Defined cases: null and empty texts have zeros everywhere and fail the base; equal rows get equal results; doc_id may be null; an
empty table gives no rows; a text of any length is measured whole; quality() keeps the other columns, and adds underscores to the
name of its own if one of them has it; keep_good() keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscope.llm.common import WORD, documents, free_names, give_back, slices
from siltscope.session import ship

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: The characters that count as symbols, and those that part words.
SYMBOLS, BLANK = "#*$%&|<>", " \t\n\v\f\r"


def repeated_windows(codes: np.ndarray, doc: np.ndarray, width: int = 3) -> np.ndarray:
    """A number for each window of width words that occurs again in its document, by its first word; -1 elsewhere."""
    n = len(codes)
    if n < width:
        return np.full(n, -1)
    many = int(codes.max()) + 1
    m = n - width + 1
    key = doc[:m] * many + codes[:m]
    for j in range(1, width):
        key = pd.factorize(key)[0] * many + codes[j : m + j]
    key = pd.factorize(key)[0]
    key[doc[:m] != doc[width - 1 :]] = -1
    count = np.bincount(key[key >= 0], minlength=1)
    out = np.full(n, -1)
    out[:m] = np.where((key >= 0) & (count[key] > 1), key, -1)
    return out


def spans_to_mask(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) > 0


def suffix_array(codes: np.ndarray, doc: np.ndarray, held: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the documents that `held` marks (by word), sorted within their documents, and each one's common prefix with the
    one before it (0 at a document's first). Words sort by their numbers, and a document's end before any word."""
    n, at = len(codes), np.flatnonzero(held)
    if not len(at):
        return at, at
    many = int(codes.max()) + 2

    def ahead(j: int) -> np.ndarray:
        i = np.minimum(at + j, n - 1)
        return np.where((at + j < n) & (doc[i] == doc[at]), codes[i] + 1, 0)

    first, second = doc[at] * many + ahead(0), ahead(1) * many + ahead(2)
    order = np.lexsort((second, first))
    sa, fresh = at[order], np.ones(len(at), bool)
    fresh[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
    rank = np.zeros(n, np.int64)
    rank[sa] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # the group's first place
    levels, h = [(width, rank)], width
    while True:
        size = np.diff(np.r_[np.flatnonzero(fresh), len(sa)])
        place = np.flatnonzero(np.repeat(size > 1, size))
        if not len(place):
            break
        who = sa[place]
        i = np.minimum(who + h, n - 1)
        after = np.where((who + h < n) & (doc[i] == doc[who]), rank[i], -1)
        by = np.lexsort((after, rank[who]))
        before, after = rank[who[by]], after[by]
        sa[place] = who[by]
        fresh = np.ones(len(sa), bool)
        fresh[place[1:]] = (np.diff(before) != 0) | (np.diff(after) != 0)
        rank, h = rank.copy(), 2 * h
        rank[who[by]] = (np.flatnonzero(fresh)[np.cumsum(fresh) - 1])[place]
        levels.append((h, rank))
    a, b = sa[:-1], sa[1:]
    end = np.searchsorted(doc, doc[sa], side="right")  # where the suffix's document ends
    together, room = doc[a] == doc[b], end[:-1] - np.maximum(a, b)
    common = np.zeros(len(a), np.int64)
    for h, rank in reversed(levels):
        common[together & (common + h <= room) & (rank[np.minimum(a + common, n - 1)] == rank[np.minimum(b + common, n - 1)])] += h
    for _ in range(width - 1):  # below the windows' width: word by word
        common[together & (common < room) & (codes[np.minimum(a + common, n - 1)] == codes[np.minimum(b + common, n - 1)])] += 1
    lcp = np.zeros(len(sa), np.int64)
    lcp[1:] = common
    return sa, lcp


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, codes: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, lengths): each suffix that lies in an interval of a maximal repeat of `least` words or more, with the longest such.

    A stack holds the intervals that are open, with their members that no maximal repeat has yet; an interval that ends and is not
    maximal hands them to the one around it, which is shorter (its own occurrences are covered by the repeat that begins a word earlier).
    """
    at = np.flatnonzero(lcp >= least)
    if not len(at):
        return at, at
    before = np.where((sa > 0) & (doc[sa - 1] == doc[sa]), codes[sa - 1], -1 - np.arange(len(sa)))  # at a document's begin: like no other
    differs = np.zeros(len(sa), bool)
    differs[1:] = before[1:] != before[:-1]
    changes = np.cumsum(differs)
    values, ends = lcp[at].tolist(), np.flatnonzero(np.append(np.diff(at) != 1, True)).tolist()
    found: list[tuple[list[int], int]] = []
    k = 0
    for end in ends:  # a run of neighbours that all share `least` words
        stack: list[list] = []  # [words, first place in sa, members]
        fresh = [int(at[k]) - 1]
        for i in range(k, end + 2):
            here = int(at[i]) if i <= end else int(at[end]) + 1
            value = values[i] if i <= end else 0
            first, members = here - 1, fresh
            while stack and stack[-1][0] > value:
                words, first, inside = stack.pop()
                inside += members
                members = inside
                if changes[here - 1] != changes[first]:
                    found.append((members, words))
                    members = []
            if stack and stack[-1][0] == value:
                stack[-1][2] += members
            elif value:
                stack.append([value, first, members])
            fresh = [here]
        k = end + 1
    members = np.array([i for m, _ in found for i in m], np.int64)
    return sa[members], np.array([n for m, n in found for _ in m], np.int64)


def measure(texts: list[str], min_words: int) -> list[list[int]]:
    """The columns of SCHEMA for each text."""
    words = [WORD.findall(t) for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    chars = [sum(map(len, w)) for w in words]
    symbols = [sum(t.count(c) for c in SYMBOLS) for t in texts]
    lines = [[x for x in t.split("\n") if x.strip(BLANK)] if "\n" in t else [] for t in texts]
    dup = [len(x) - len(set(x)) for x in lines]
    flat = [x for w in words for x in w]
    codes = pd.factorize(np.array(flat, object))[0].astype(np.int64) if flat else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    windows = repeated_windows(codes, doc)
    at = np.flatnonzero(windows >= 0)
    total = lambda mask: np.bincount(doc[mask], minlength=len(texts))
    repeat = total(spans_to_mask(at, np.full(len(at), 3), len(codes)))
    some = np.zeros(len(texts), bool)
    some[doc[at]] = True  # no other document has a repeat of three words
    sa, lcp = suffix_array(codes, doc, some[doc])
    longest = np.zeros(len(texts), np.int64)
    covered = longest
    if len(sa):
        place, size = maximal_repeats(sa, lcp, codes, doc, min_words)
        np.maximum.at(longest, doc[sa], lcp)  # shorter ones count as well; the longest is maximal
        covered = total(spans_to_mask(place, size, len(codes)))
    return [list(n_words), chars, symbols, dup, list(repeat), list(covered), list(longest)]


def quality(docs: DataFrame, min_words: int = 8, max_covered: float = 0.45, max_longest: int = 100, into: str = "q") -> DataFrame:
    """docs (with a column text) plus a struct column `into`: the measures, base_failed and kept."""
    ship(docs.sparkSession)
    (into,) = free_names(docs, into)
    names = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                got = measure([x or "" for x in part.column("text").to_pylist()], min_words)
                q = pa.StructArray.from_arrays([pa.array(np.asarray(c, np.int64)) for c in got], names=NAMES)
                yield pa.RecordBatch.from_arrays([*part.columns, q], names=[*names, into])
        give_back()

    out = docs.mapInArrow(run, _with(docs, into))
    q = F.col(f"`{into}`")
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    fine = (q["covered_words"] <= max_covered * q["n_words"]) & (q["longest_repeat"] <= max_longest)
    return out.withColumn(into, F.struct(*[q[n].alias(n) for n in NAMES], failed.alias("base_failed"), (~failed & fine).alias("kept")))


def _with(docs: DataFrame, into: str):
    from pyspark.sql import types as T

    return T.StructType([*docs.schema.fields, T.StructField(into, T.StructType([T.StructField(n, T.LongType()) for n in NAMES]))])


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    out = quality(docs, **limits)
    return out.where(F.col(f"`{out.columns[-1]}`")["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = quality(docs)
    return out.select("doc_id", *[F.col(f"q.{n}").alias(n) for n in [*NAMES, "base_failed", "kept"]])


#: DuckDB SQL of op9_quality_rules. Repeats are runs of equal 3-word windows at one distance; those of 8 words and more are united.
OP9_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS x FROM documents),
d AS (SELECT uid, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM t),
p AS (SELECT uid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
c AS (SELECT uid, i, dense_rank() OVER (ORDER BY w) AS w FROM p),
three AS (SELECT uid, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM c WINDOW o AS (PARTITION BY uid ORDER BY i)),
again AS (SELECT uid, i, a, b, c FROM (SELECT *, count(*) OVER (PARTITION BY uid, a, b, c) AS n FROM three WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT uid, count(DISTINCT j) AS n_repeat_words FROM (SELECT uid, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY uid),
named AS (SELECT uid, i, dense_rank() OVER (ORDER BY uid, a, b, c) AS g FROM again),
pairs AS (SELECT x.uid, x.i, y.i - x.i AS k FROM named x JOIN named y ON x.uid = y.uid AND x.g = y.g AND x.i < y.i),
runs AS (SELECT uid, k, min(i) AS first, max(i) + 2 AS last FROM (SELECT *, i - row_number() OVER (PARTITION BY uid, k ORDER BY i) AS run FROM pairs) GROUP BY uid, k, run),
longest AS (SELECT uid, max(last - first + 1) AS longest_repeat FROM runs GROUP BY uid),
spans AS (SELECT uid, first AS s, last AS e FROM runs WHERE last - first >= 7 UNION ALL SELECT uid, first + k, last + k FROM runs WHERE last - first >= 7),
covered AS (SELECT uid, sum(e - greatest(s, coalesce(before, -1) + 1) + 1)::BIGINT AS covered_words FROM (SELECT *, max(e) OVER (PARTITION BY uid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans) WHERE e > coalesce(before, -1) GROUP BY uid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(covered_words, 0)::BIGINT AS covered_words, coalesce(longest_repeat, 0)::BIGINT AS longest_repeat
  FROM (SELECT *, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d) LEFT JOIN rep USING (uid) LEFT JOIN covered USING (uid) LEFT JOIN longest USING (uid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered_words <= 0.45::DOUBLE * n_words AND longest_repeat <= 100 AS kept FROM m
"""
