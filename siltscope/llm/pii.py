"""Operator 4: personal data becomes format-preserving Feistel pseudonyms.

A find is a span that a pattern proposes and a check confirms (Luhn for cards, numbering plans for phones, the calendar for dates, ...).
Its letters and digits are permuted within its format by a keyed Feistel network: one half of the places is shifted, each within
its own alphabet, by a key stream drawn from the other half, in turn; dates and addresses are permuted as numbers. Where the format has a check of its own (a card's last digit, an account's control digits, a day of the calendar) only
what is free is permuted and the check is set anew, or the network is walked until the value is valid again. The same value under
the same key always has the same pseudonym, in any document, so linkage stays; the permutation can be undone with the key.

Kinds: e-mail addresses (local part; the host is kept), phone numbers (country code kept), payment cards (issuer digit kept), US
social security numbers, bank accounts (IBAN; country kept), IPv4 and MAC addresses, dates (ISO and d/m/y orders; among the days
of 1900 to 2099), and secrets (hexadecimal or base-62 strings of any length after a name such as token or key, and known key prefixes).

Defined cases: null text stays null and has no finds; empty text stays empty; equal rows are treated alike; doc_id may be null;
overlapping finds go to the earlier, then the longer; an empty table gives no rows; all columns of the input are kept as they
are, but for text, and if one has the name asked for the spans, the spans get underscores ahead of it. Texts of any length are
searched whole, and finds of any length are taken whole, in time that is linear in their length.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltscope.llm.common import documents, free_names, slices
from siltscope.llm.tokens import Memo
from siltscope.session import ship

HEX = frozenset("0123456789abcdef")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY


class Feistel:
    """Keyed permutations. permute: of the numbers 0 .. size - 1 (size up to 2 ** 64), by a two-part network on a domain just above
    size, walked into range. letters: of strings over given alphabets."""

    def __init__(self, key: bytes, rounds: int = 10):
        self.key, self.rounds = key, rounds

    def stream(self, k: int, tweak: bytes, other: bytes, n: int) -> list[int]:
        """n numbers of 64 bits that depend on the key, the round, the tweak and the other half."""
        seed = hashlib.blake2b(b"%d|%d|" % (k, len(tweak)) + tweak + other, key=self.key, digest_size=32).digest()
        bits = hashlib.shake_256(seed).digest(8 * n)
        return [int.from_bytes(bits[i : i + 8], "little") for i in range(0, 8 * n, 8)]

    def _round(self, k: int, tweak: bytes, value: int, below: int) -> int:
        """For numbers below 2 ** 64."""
        return self.stream(k, tweak, b"%d|%d" % (below, value), 1)[0] % below

    def letters(self, x: list[int], sizes: list[int], tweak: str, back: bool = False) -> list[int]:
        """A permutation of the strings x whose i-th symbol is below sizes[i]; at least two symbols. Any length, linear time."""
        h, t, x = len(x) // 2, tweak.encode(), list(x)
        for k in reversed(range(self.rounds)) if back else range(self.rounds):
            (lo, hi), other = ((0, h), x[h:]) if k % 2 else ((h, len(x)), x[:h])
            key = self.stream(k, t, bytes(other), hi - lo)
            for i, r in zip(range(lo, hi), key):
                x[i] = (x[i] + (-r if back else r)) % sizes[i]
        return x

    def _pass(self, x: int, a: int, b: int, tweak: bytes, back: bool) -> int:
        left, right = divmod(x, b)
        for k in reversed(range(self.rounds)) if back else range(self.rounds):
            sign = -1 if back else 1
            if k % 2:
                right = (right + sign * self._round(k, tweak, left, b)) % b
            else:
                left = (left + sign * self._round(k, tweak, right, a)) % a
        return left * b + right

    def permute(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        if size < 2:
            return x
        a = max(2, int(size**0.5))
        b = -(-size // a)
        while True:  # a * b is less than size + a: a few steps at most on average
            x = self._pass(x, a, b, tweak.encode(), back)
            if x < size:
                return x


def luhn(digits: str) -> int:
    """The sum of Luhn's rule modulo 10: 0 for a valid number."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


class Pseudonyms:
    """replace(kind, text) of one find."""

    def __init__(self, key: bytes):
        self.f = Feistel(key)
        self.of = {k: Memo(lambda s, k=k: getattr(self, k)(s), 100_000) for k, _, _ in RULES}

    def shaped(self, s: str, tweak: str, free=None) -> str:
        """Permute the letters and digits of s, each within its own class, at the places where free(i) holds."""
        at = [i for i in range(len(s)) if (free is None or free(i)) and (s[i] in DIGITS or s[i] in LOWER or s[i] in UPPER)]
        sets = [next(a for a in (DIGITS, LOWER, UPPER) if s[i] in a) for i in at]
        x, tweak, out = [a.index(s[i]) for i, a in zip(at, sets)], f"{tweak}|{''.join(a[0] for a in sets)}", list(s)
        sizes = [len(a) for a in sets]
        new = self.f.letters(x, sizes, tweak) if len(x) > 1 else [self.f.permute(v, n, tweak) for v, n in zip(x, sizes)]
        for i, a, v in zip(at, sets, new):
            out[i] = a[v]
        return "".join(out)

    def digits(self, s: str, tweak: str, keep: int = 0, keep_end: int = 0) -> str:
        at = [i for i, c in enumerate(s) if c in DIGITS]
        free = set(at[keep : len(at) - keep_end])
        return self.shaped(s, tweak, free.__contains__)

    def email(self, s: str) -> str:
        local, _, host = s.rpartition("@")
        return f"{self.shaped(local, 'email|' + host.lower())}@{host}"

    def phone(self, s: str) -> str:
        return self.digits(s, "phone", keep=max(0, sum(c in DIGITS for c in s) - 10) if s.startswith("+") else 0)

    def card(self, s: str) -> str:
        """The first digit stays; the last is set so that the number is valid exactly if it was."""
        was = luhn(re.sub(r"\D", "", s))
        out = self.digits(s, f"card|{was}", keep=1, keep_end=1)
        last = max(i for i, c in enumerate(out) if c in DIGITS)
        return next(t for d in DIGITS for t in [out[:last] + d + out[last + 1 :]] if luhn(re.sub(r"\D", "", t)) == was)

    def ssn(self, s: str) -> str:
        x = s
        while True:
            x = self.digits(x, "ssn")
            if is_ssn(x):
                return x

    def iban(self, s: str) -> str:
        out = self.shaped(s, "iban", lambda i: i >= 4)
        bare = out.replace(" ", "")
        return out[:2] + f"{98 - iban_rest(bare[:2] + '00' + bare[4:]):02d}" + out[4:]

    def ip(self, s: str) -> str:
        x = 0
        for p in s.split("."):
            x = x * 256 + int(p)
        x = self.f.permute(x, 1 << 32, "ip")
        return ".".join(str(x >> k & 255) for k in (24, 16, 8, 0))

    def mac(self, s: str) -> str:
        hexa = re.sub(r"[^0-9A-Fa-f]", "", s)
        new = iter(f"{self.f.permute(int(hexa, 16), 1 << 48, 'mac'):012{'x' if s.lower() == s else 'X'}}")
        return "".join(next(new) if c in "0123456789abcdefABCDEF" else c for c in s)

    def date(self, s: str) -> str:
        shape = date_of(s)
        day, write = shape
        day = self.f.permute(day.toordinal() - FIRST_DAY, DAYS, "date")
        return write(datetime.date.fromordinal(FIRST_DAY + day))

    def secret(self, s: str) -> str:
        if HEX.issuperset(s):
            new = self.f.letters([int(c, 16) for c in s], [16] * len(s), f"hex|{len(s)}")
            return "".join(["0123456789abcdef"[v] for v in new])
        return self.shaped(s, "secret", lambda i: i >= (4 if PREFIXED.match(s) else 0))


def date_of(s: str) -> tuple[datetime.date, Callable[[datetime.date], str]] | None:
    """The day that s names, and how to write another in the same format; None if there is no such day from 1900 to 2099."""
    parts = re.split(r"([-/.])", s)
    if len(parts) != 5 or parts[1] != parts[3]:
        return None
    a, sep, b, _, c = parts
    orders = [("ymd", (a, b, c))] if len(a) == 4 else [("dmy", (c, b, a)), ("mdy", (c, a, b))]
    if sep == "/":
        orders.sort(reverse=True)  # with slashes the month usually comes first
    for order, (y, m, d) in orders:
        try:
            day = datetime.date(int(y), int(m), int(d))
        except ValueError:
            continue
        if 0 <= day.toordinal() - FIRST_DAY < DAYS:
            width = {"m": len(m), "d": len(d), "y": 4}

            def write(t: datetime.date, order=order, width=width) -> str:
                one = {"y": f"{t.year:04d}", "m": f"{t.month:02d}", "d": f"{t.day:02d}"}
                return sep.join(one[k] if width[k] > 1 else str(int(one[k])) for k in order)

            return day, write
    return None


def is_card(s: str) -> bool:
    d = re.sub(r"\D", "", s)
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn(d) == 0


def country_code(d: str) -> int:
    """How many digits of an international number are its country's code, 0 if there is no such code."""
    if d[0] in "17":
        return 1
    if d[:2] in TWO_DIGIT_CODES:
        return 2
    return 3 if d[:2] in THREE_DIGIT_CODES else 0


def is_phone(s: str) -> bool:
    """International numbers: an assigned country code and 7 to 15 digits in all; in country 1, ten digits after it, of any area (reserved ones
    too). Others: ten digits of the North American plan."""
    d = re.sub(r"\D", "", s)
    if s[0] == "+":
        n = country_code(d) if d else 0
        return bool(n) and 7 <= len(d) <= 15 and len(d) - n >= 4 and (d[0] != "1" or len(d) == 11)
    return len(d) == 10 and d[0] > "1" and d[3] > "1"


def is_ssn(s: str) -> bool:
    a, b, c = s[:3], s[4:6], s[7:]
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


def is_iban(s: str) -> bool:
    bare = s.replace(" ", "")
    return 15 <= len(bare) <= 34 and iban_rest(bare) == 1


def is_ip(s: str) -> bool:
    return all(int(p) < 256 and (p == "0" or p[0] != "0") for p in s.split("."))


#: International codes of two digits, and how those of three digits begin.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
THREE_DIGIT_CODES = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: The length of an account number in each country of the registry.
IBAN_LENGTH = {c: n for n, names in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in names.split()}


def iban_ends(s: str) -> list[int]:
    """Where an account number may end in s, which may hold the next words too: at its country's length, else where s does."""
    n = IBAN_LENGTH.get(s[:2])
    return [i for i, c in enumerate(s) if c == " " and i - s.count(" ", 0, i) == n] + [len(s)]


def card_ends(s: str) -> list[int]:
    """Where a card's number may end in s, which may hold the next number too: where s does, then before each part."""
    return [len(s), *[i for i in range(len(s) - 1, 0, -1) if s[i] in " -"]]


def phone_ends(s: str) -> list[int]:
    """As card_ends, for the separators of phone numbers."""
    return [len(s), *[i for i in range(len(s) - 1, 0, -1) if s[i] in " .-"]]


#: Where a find of a kind may end within its match, in the order of trial; other kinds end where the match does.
ENDS: dict[str, Callable[[str], list[int]]] = {"iban": iban_ends, "card": card_ends, "phone": phone_ends}
#: Prefixes of well-known key formats.
PREFIXED = re.compile(r"AKIA|ASIA|gh[opsur]_|sk-|sk_|xox[abp]-|AIza")
#: kind, pattern, check; the order decides between finds at the same place. A group, if there is one, is the part to replace.
RULES: list[tuple[str, str, Callable[[str], bool] | None]] = [
    ("email", r"(?<![A-Za-z0-9._%+-])[._%+-]*+([A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})(?![A-Za-z0-9])", None),
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:gh[opsur]_|sk-|sk_|xox[abp]-|AIza)[A-Za-z0-9_-]{16,}+", None),
    ("secret", r"(?i:token|secret|passw(?:or)?d|pwd|api_?key|access_?key|auth)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9+/_-]{8,}+)", lambda s: any(c in DIGITS for c in s)),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", is_iban),
    ("mac", r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:([:-]))[0-9A-Fa-f]{2}(?:\1[0-9A-Fa-f]{2}){4}(?![0-9A-Fa-f:-])", None),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9/-])(?!\.[0-9])", lambda s: date_of(s) is not None),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])", is_ip),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", is_ssn),
    ("card", r"(?<![0-9-])(?:[0-9]{4}[ -]?){3}(?:[0-9]{4}[ -][0-9]{1,3}|[0-9]{1,7})(?![0-9])|(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])", is_card),
    ("phone", r"(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])", is_phone),
]
KINDS = list(dict.fromkeys(k for k, _, _ in RULES))
_compiled = [(k, re.compile(p), ok, k in ("secret", "email")) for k, p, ok in RULES]
#: No find is without a digit or an at sign.
_some = re.compile(r"[0-9@]")


def within(kind: str, rx: re.Pattern, ok: Callable[[str], bool], text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the confirmed finds of a kind of ENDS. A match that fails hides none that begins inside it."""
    at = 0
    while m := rx.search(text, at):
        at = m.start() + 1
        for n in ENDS[kind](m.group()):
            if ok(m.group()[:n]):
                at = m.start() + n
                yield m.start(), at
                break


def finds(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the finds, in order and apart from each other."""
    if not _some.search(text):
        return []
    got = []
    for order, (kind, rx, ok, inner) in enumerate(_compiled):
        if kind in ENDS:
            got += [(s, -e, order, kind) for s, e in within(kind, rx, ok, text)]
            continue
        for m in rx.finditer(text):
            g = 1 if inner and m.re.groups and m.group(1) else 0
            if ok is None or ok(m.group(g)):
                got.append((m.start(g), -m.end(g), order, kind))
    out, last = [], 0
    for s, e, _, kind in sorted(got):
        if s >= last:
            out.append((s, -e, kind))
            last = -e
    return out


def pseudonymize(text: str, names: Pseudonyms) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its finds replaced, and the finds as (start in the new text, length, kind)."""
    out, spans, last, n = [], [], 0, 0
    for s, e, kind in finds(text):
        new = names.of[kind][text[s:e]]
        out += [text[last:s], new]
        n += s - last
        spans.append((n, len(new), kind))
        n, last = n + len(new), e
    return "".join([*out, text[last:]]), spans


_names: dict[bytes, Pseudonyms] = {}
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("kind", T.StringType())]))


def mask(docs: DataFrame, key: bytes, spans: str = "pii_spans") -> DataFrame:
    """docs with pseudonyms in its column text, and a column of the spans that were replaced (null text: no spans)."""
    ship(docs.sparkSession)
    (spans,) = free_names(docs, spans)
    names = [f.name for f in docs.schema]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _names[key] = _names.get(key) or Pseudonyms(key)
        for b in batches:
            for part in slices(b, "text"):
                got = [(None, []) if x is None else pseudonymize(x, p) for x in part.column(at).to_pylist()]
                cols = list(part.columns)
                cols[at] = pa.array([t for t, _ in got], pa.string())
                kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string())]))
                cols.append(pa.array([[dict(zip(("start", "length", "kind"), x)) for x in s] for _, s in got], kind))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, spans])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(spans, SPANS)]))


#: The key is a parameter of mask(); deployments pass their own. The queries and the pipeline use this one, so that runs agree.
EXAMPLE_KEY = b"example key; replace it"


def op4_pii(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = mask(documents(spark, sf_dir).select("doc_id", "text"), EXAMPLE_KEY)
    is_kind = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("pii_spans", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_finds"), *counts)
