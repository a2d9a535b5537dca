"""Chunked encoding against the library, in memory and as tables."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from siltscope.llm import bpe


@pytest.fixture(scope="module")
def lib():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "b", " ", "  ", "\n", "'s", "12", "!", "é", "x" * 15, " " * 14, "²", "日本", "\x1c", "́", "z" * 60, " \n" * 30, "1" * 45]


def test_all_chunk_lengths(lib):
    for size, overlap in ((40, 12), (7, 3), (16, 16), (30, 1)):
        c = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk=size, overlap=overlap)
        for k in range(400):
            text = "".join(random.Random(k).choices(PARTS, k=k % 40))
            ids = c.encode(text)
            assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text) and c.decode(ids) == text.encode(), (size, overlap, k)


def test_long_texts_and_runs(lib):
    c = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    r = random.Random(1)
    prose = " ".join("".join(r.choices("etaoinsh", k=r.randint(1, 9))) for _ in range(1_000_000))
    for text in (prose, "word " * 30_000 + "7" * 200_000 + " tail" * 30_000, "\n" * 150_000 + "x"):
        began = time.time()
        ids = c.encode(text)
        assert time.time() - began < 60 and c.decode(ids) == text.encode()
        if text[0] == prose[0]:
            assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text)


def test_query_against_the_library(spark, tmp_path, lib):
    r = random.Random(2)
    texts = [(1, "Hello, world"), (2, None), (3, ""), (None, "x"), (4, "".join(r.choices(PARTS, k=30_000))), (4, "y " * 40_000), (4, "y " * 40_000), (5, "q" * 70_000 + " end")]
    spark.createDataFrame([(i, t, "u", "k", "p") for i, t in texts], "doc_id long, text string, uid string, k string, part string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    out = bpe.op10_bpe(spark, str(tmp_path))
    got = sorted(((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in out.collect()), key=repr)
    want = []
    for i, t in texts:
        ids = lib.encode_ordinary(t or "") if i != 5 else np.frombuffer(bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode(t), "<u4").tolist()
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(uid") >= 2 and "k#" in plan  # chunks are dealt out before they are split
    assert out.where(F.col("doc_id") == 2).count() == 1
