"""Personal data against a finder of its own: values made by rule, planted in prose, and found again by splitting at blanks."""

import calendar
import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from siltscope.llm import pii

LETTERS = string.ascii_letters


def luhn_ok(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def made(kind, r):
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == "email":
        return f"{''.join(r.choice(LETTERS) for _ in range(r.randint(1, 90)))}@{r.choice(['mail', 'a-b'])}.example.{r.choice(['com', 'org'])}"
    if kind == "card":
        while not luhn_ok(d := "4" + digits(15)):
            pass
        return r.choice([d, " ".join(re.findall("....", d)), "-".join(re.findall("....", d))])
    if kind == "phone":
        return f"+1 ({digits(3)}) 555-{digits(4)}"
    if kind == "date":
        y, m = r.randint(1900, 2099), r.randint(1, 12)
        return f"{y}-{m:02d}-{r.randint(1, calendar.monthrange(y, m)[1]):02d}"
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "ssn":
        return f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
    if kind == "mac":
        return ":".join("".join(r.choice("0123456789abcdef") for _ in range(2)) for _ in range(6))
    if kind == "secret":
        return f"ghp_{''.join(r.choice(LETTERS + string.digits) for _ in range(r.randint(16, 400)))}"
    if kind == "iban":
        body = digits(18)
        check = 98 - int(body + "131400") % 97
        return f"DE{check:02d}{body}"


def test_planted_values_are_found_and_nothing_else():
    r = random.Random(4)
    p = pii.Pseudonyms(b"k")
    for n in range(300):
        parts, want, at = [], [], 0
        for _ in range(r.randint(1, 12)):
            word = "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(1, 9)))
            parts.append(word)
            at += len(word) + 1
            if r.random() < 0.5:
                kind = r.choice(["email", "card", "phone", "date", "ip", "ssn", "mac", "secret", "iban"])
                v = made(kind, r)
                want.append((at, at + len(v), kind))
                parts += [v, "and"]
                at += len(v) + 5
        text = " ".join(parts)
        assert pii.finds(text) == want
        new, spans = pii.pseudonymize(text, p)
        assert len(new) == len(text) or any(k == "ip" for *_, k in want)
        for (s, e, kind), (at, size, k) in zip(want, spans):
            got = new[at : at + size]
            assert k == kind and p.of[kind][text[s:e]] == got
            if kind == "card":
                assert luhn_ok(re.sub(r"\D", "", got))


@pytest.mark.parametrize("alphabet", ["0123456789abcdef", string.ascii_letters + string.digits, "ab1"])
@pytest.mark.parametrize("n", [10, 63, 64, 65, 184, 185, 196, 200, 201, 1000, 100_000])
def test_secrets_of_any_length(alphabet, n):
    r = random.Random(n)
    value = "".join(r.choice(alphabet) for _ in range(n - 1)) + "7"
    began = time.time()
    out, spans = pii.pseudonymize(f"token: {value} end", pii.Pseudonyms(b"k"))
    assert time.time() - began < 5
    assert [(x[1], x[2]) for x in spans] == [(n, "secret")] and out.startswith("token: ") and out.endswith(" end")
    new = out[7:-4]
    assert len(new) == n and value not in out
    kind = lambda c: "h" if set(alphabet) <= set("0123456789abcdef") else "d" if c.isdigit() else "l" if c.islower() else "u"
    assert [kind(c) for c in new] == [kind(c) for c in value]


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "a1" * 150_000, "." * 300_000 + "@", "token " + " " * 300_000, "1 " * 100_000, "4111 " * 60_000, "a@" * 100_000):
        began = time.time()
        pii.pseudonymize(text, pii.Pseudonyms(b"k"))
        assert time.time() - began < 20, text[:10]


def test_strings_are_permuted():
    f = pii.Feistel(b"k")
    sizes = [3, 2, 4]
    every = [[a, b, c] for a in range(3) for b in range(2) for c in range(4)]
    assert sorted(f.letters(x, sizes, "t") for x in every) == every
    assert all(f.letters(f.letters(x, sizes, "t"), sizes, "t", back=True) == x for x in every)


@pytest.mark.parametrize(("text", "n"), [("+1 (017) 555-7713", 1), ("+1 (826) 555-4081 190.137", 1), ("+49 30 901820", 1), ("+999 30 901820", 1), ("+28 30 901820", 0), ("+1 555 123", 0), ("(212) 555-2368", 1), ("(112) 555-2368", 0), ("212-155-2368", 0)])
def test_phones_follow_a_plan(text, n):
    spans = [(s, e) for s, e, k in pii.finds(f"x {text} y") if k == "phone"]
    assert len(spans) == n and (not n or spans[0][0] == 2)


def test_clashing_names_and_query(spark, tmp_path):
    df = spark.createDataFrame([(1, "at 10.1.2.3", "mine"), (None, None, None), (2, "", "x"), (2, "", "x")], "doc_id long, text string, pii_spans string")
    out = pii.mask(df, b"k")
    assert out.columns == ["doc_id", "text", "pii_spans", "_pii_spans"]
    assert sorted(((r.doc_id, r.pii_spans, len(r._pii_spans)) for r in out.collect()), key=repr) == [(1, "mine", 1), (2, "x", 0), (2, "x", 0), (None, None, 0)]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_finds, r.n_ip) for r in pii.op4_pii(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 1), (2, 0, 0), (None, 0, 0)}
    assert pii.op4_pii(spark, str(tmp_path)).select(F.sum("n_finds")).first()[0] == 1
