"""The pipeline against a plain version of its stages, each by its definition and apart from the operators' code."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tests_llm_texts import LONG, PASSAGE, TABLE
from tokenizers import Tokenizer

from siltscope.llm import pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pii_spans string, digest string, q string, __row string, bin string, root string"
EXTRA = ("s", "d", "q", "r", "b", "o")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, *EXTRA) for r in TABLE], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def good(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    c = Counter(zip(w, w[1:], w[2:]))
    rep = {j for k in range(n - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    if n < 50 or 100 * len(rep) > 50 * n:
        return False
    at, covered, longest = {}, set(), 0
    for i in range(n - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    for group in at.values():
        for i in group:
            for j in group:
                k = 0
                while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                    k += 1
                longest = max(longest, k)
                covered.update(range(i, i + k))
    return len(covered) <= 0.45 * n and longest <= 100


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def one_of_each(rows):
    fp, root = [fingerprint(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 4:
                root = [root[j] if x == root[i] else x for x in root]
    rank = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    return [rows[min((k for k in range(len(rows)) if root[k] == r), key=rank)] for r in sorted(set(root))]


def without_repeats(rows):
    data = [t.encode() for _, t, *_ in rows]
    count = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for r, d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if count[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        text, at = "", 0
        for c in r[1]:
            n = len(c.encode())
            text += "" if gone[at : at + n].all() else c
            at += n
        out.append((r[0], text, *r[2:]))
    return out


def test_stages_and_run(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "pii", "packing"]
    from siltscope.session import cut

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        docs = cut(out, name)
        seen.append(docs.collect())
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    rows = sorted((r for r in TABLE if good(r[1])), key=key)
    assert len(rows) >= 9 and sorted((tuple(r)[:5] for r in seen[0]), key=key) == rows
    rows = sorted(one_of_each(rows), key=key)
    assert [r[0] for r in rows] == [1, 10, 11, 20, 30, 40, None] and sorted((tuple(r)[:5] for r in seen[1]), key=key) == rows
    rows = [(i, t, a, b, len(t)) for i, t, a, b, _ in without_repeats(rows)]
    assert sum(PASSAGE in r[1] for r in rows) == 0 and sorted((tuple(r)[:5] for r in seen[2]), key=key) == sorted(rows, key=key)
    assert all(tuple(r)[5:] == EXTRA for r in seen[2])
    for was, now in zip(sorted(seen[2], key=key), sorted(seen[3], key=lambda r: (r[0] is None, r[0] or 0))):
        assert was.doc_id == now.doc_id and now.n_chars == len(now.text)
        if was.doc_id == 30:
            assert "jo.doe@" in was.text and "jo.doe@" not in now.text and re.sub(r"[a-z]+\.[a-z]+@", "@", was.text) == re.sub(r"[a-z]+\.[a-z]+@", "@", now.text)
        else:
            assert was.text == now.text
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size, bins = Counter(), {}
    for r in seen[4]:
        size[r.doc_id] += r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert size == {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen[3]}
    assert all(sum(n for _, n in b) <= 2048 and sum(n for _, n in b) == max(o + n for o, n in b) for b in bins.values())
    got = corpus_pipeline.run(spark, folder)
    fixed = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert got.columns == [*fixed, "sequence_id", "offset"]
    assert sorted((repr(tuple(r[c] for c in fixed)) for r in got.collect())) == sorted(repr(tuple(r[c] for c in fixed)) for r in seen[4])
    assert corpus_pipeline.ORACLE_SQL is None and pii.EXAMPLE_KEY and LONG in {r.text for r in seen[3]}


def test_later_stages_take_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, None), (2, "")], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, df, "")
        assert out.columns == ["doc_id", "text"] and out.count() == (1 if name == "near_duplicates" else 4)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
