"""Maximal repeats against their definition, the query, and clashing names."""

import random
import re
import time
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltscope.llm import quality


def brute(words, least):
    """(words covered by maximal repeats of `least` words or more, the longest repeat) by the definition, over all substrings."""
    n, covered, longest = len(words), set(), 0
    for size in range(1, n):
        places = {}
        for i in range(n - size + 1):
            places.setdefault(tuple(words[i : i + size]), []).append(i)
        for at in places.values():
            if len(at) < 2:
                continue
            longest = max(longest, size)
            left = {words[i - 1] if i else None for i in at}
            right = {words[i + size] if i + size < n else None for i in at}
            if size >= least and (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
                covered.update(j for i in at for j in range(i, i + size))
    return len(covered), longest


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=40), max_size=4), st.integers(3, 6))
def test_maximal_repeats(texts, least):
    texts = [" ".join(t) for t in texts]
    got = quality.measure(texts, least)
    for k, t in enumerate(texts):
        covered, longest = brute(t.split(), least)
        assert got[5][k] == covered and (got[6][k] == longest or longest < 3)


def test_nested_and_many():
    r = random.Random(3)
    a, b = ([str(r.randint(0, 9999)) for _ in range(n)] for n in (20, 12))
    words = a + ["x"] + b + a + ["y"] + a[5:] + b + ["z"] + a[:9]
    got = quality.measure([" ".join(words)], 8)
    assert (got[5][0], got[6][0]) == brute(words, 8)
    assert quality.maximal_repeats(np.array([0, 5]), np.array([0, 9]), np.zeros(20, np.int64), np.zeros(20, np.int64), 8)[0].dtype == np.int64
    got = quality.measure([" ".join(["s"] + a + ["t"] + a), " ".join(["u"] + b + a + ["u"] + b + a)], 8)  # intervals whose members have all been given
    assert [got[5][k] for k in (0, 1)] == [40, 66]
    began = time.time()
    got = quality.measure(["w " * 20_000], 8)
    assert got[5][0] == 20_000 and got[6][0] == 19_999 and time.time() - began < 10


def test_op9_query_and_names(spark, tmp_path):
    r = random.Random(1)
    prose = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    p = prose(40)
    texts = [(1, prose(80)), (2, None), (3, ""), (None, " \t\n"), (4, "few words # * |"), (4, "few words # * |"), (5, f"{p} {prose(5)} {p}"), (6, "same line\nsame line\n\n \nother " * 9), (7, prose(3000)), (8, "é" * 10 + " " + prose(60))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, q int, __quality int")
    assert quality.quality(df).columns == ["doc_id", "text", "q", "__quality", "_q"]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [1, 7, 8]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = quality.op9_quality_rules(spark, str(tmp_path)).collect()
    want = []
    for i, t in texts:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(zip(w, w[1:], w[2:]))
        rep = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        covered, longest = brute(w, 8) if len(w) < 500 else (0, 0)
        want.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(rep), failed, not failed and covered <= 0.45 * len(w) and longest <= 100))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted((tuple(x[n] for n in names) for x in got), key=repr) == sorted(want, key=repr)
    assert np.array([x["kept"] for x in got]).sum() == 3
