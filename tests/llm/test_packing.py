"""Packing: whole, gapless, near the lower bound, and no group that grows with the number of tasks."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltscope.llm import packing


def bins_of(rows, capacity):
    spots = {}
    for r in rows:
        spots.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spots.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(spots)


def test_merging_of_hundreds_of_tasks_stays_bounded(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    sizes = [min(100, int(r.expovariate(1 / 30)) + 1) for _ in range(20_000)]
    rows = [(i, n, "a", "b", "c", "d", "e", 7, 8) for i, n in enumerate(sizes)]
    spark.createDataFrame(rows, "i long, length long, bin string, at string, root string, shift string, leaf string, sequence_id int, offset int").repartition(300).write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "2k")
    merged = []
    cut = packing.cut

    def watched(df, name):
        out = cut(df, name)
        if name == "merged":
            merged.append(out.groupBy((F.shiftright("to", 32)).alias("t")).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(packing, "cut", watched)
    p = spark.read.parquet(str(tmp_path / "p"))
    try:
        assert p.rdd.getNumPartitions() > 200
        out = packing.pack(p, 100, open_bins=16, fan_in=4).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(x.i for x in out) == list(range(20_000)) and {(x.bin, x.at, x.root) for x in out} == {("a", "b", "c")}
    assert bins_of(out, 100) <= sum(sizes) / 100 * 1.04 + 16
    assert len(merged) >= 2 and max(merged) <= 4 * 16  # rounds may end early, when one joins little; four tasks' open bins, whatever the number of tasks


def test_full_pieces_close_no_bin():
    b = packing.Bins(10, 4)
    for n in (6, 7, 8, 9):
        b.put(n)
    before = sorted(b.rest())
    assert [b.put(10) for _ in range(5)] == [(k, 0, k) for k in range(4, 9)] and sorted(b.rest()) == before and b.open == 4


def test_query(spark, tmp_path):
    texts = [(1, "one two three"), (2, None), (3, ""), (3, ""), (None, "x"), (4, "word " * 5000), (5, "y" * 3)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op8_best_fit(spark, str(tmp_path)).collect()
    lib, total = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for i, t in texts:
        total[i] = total.get(i, 0) + len(lib.encode(t or "", add_special_tokens=False).ids) + 1
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == total and bins_of(rows, 2048) == -(-sum(total.values()) // 2048)
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 4)
    assert [n for _, _, n in long[1:]] == [2048] * (len(long) - 1) and long[0][2] == total[4] % 2048
