"""Token files and token counts: prefix sums, the queries, and rows that repeat or clash."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltscope.llm import token_counts, token_files

TEXTS = [(3, "three words here"), (1, None), (2, ""), (None, "no id"), (3, "three words here"), (7, "long " * 3000), (5, "Émigré ÀÉ don't <unk> 12")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "a", 1, 2) for i, t in TEXTS]
    spark.createDataFrame(rows, "doc_id long, text string, digest string, part int, n_tokens int").repartition(2).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("fan", [4096, 3, 2])
def test_prefix_sums(spark, fan):
    r = random.Random(1)
    rows = [(i, r.randint(0, 9), r.randint(0, 1 << 40)) for i in range(50) if i not in (0, 7, 20)]
    df = spark.createDataFrame(rows, "part int, n_docs long, n_tokens long").repartition(5)
    got = {x.part: (x.sum_n_docs, x.sum_n_tokens) for x in token_files.prefix_sums(df, "part", 50, ["n_docs", "n_tokens"], fan).collect()}
    assert got == {i: (sum(a for j, a, _ in rows if j < i), sum(b for j, _, b in rows if j < i)) for i, _, _ in rows}


def test_op3_query(spark, folder):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(i, [*lib.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in TEXTS]
    got = sorted(token_files.op3_token_files(spark, folder).collect(), key=lambda x: x.start)
    at = 0
    for x in got:
        assert x.start == at
        at += x.n_tokens
    assert [x.doc_id for x in got] == sorted((i for i, _ in ids), key=lambda i: (i is not None, i or 0))
    key = lambda x: repr(x)
    assert sorted(((x.doc_id, x.n_tokens, x.ids_crc32) for x in got), key=key) == sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids), key=key)


def test_op7_query(spark, folder):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(i, len((t or "").encode()), n, n > 1024) for i, t in TEXTS for n in [len(lib.encode(t or "", add_special_tokens=False).ids)]]
    got = token_counts.op7_token_counts(spark, folder)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and any(x[3] for x in want)
