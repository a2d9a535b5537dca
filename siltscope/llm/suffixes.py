"""External induced sorting of suffixes, with their common prefixes.

A suffix is small (S) or large (L) by whether it is below or above the one after it; an S suffix with an L before it is a seed. The
seeds' substrings, each up to the next seed, are sorted by inducing from their first symbols, and named; if names repeat, the
string of names is sorted by the same function, recursively, until it fits in memory. From the sorted seeds an ascending pass over a priority queue yields
all L suffixes (the one taken hands in the suffix before it), and a descending pass all S suffixes.

What a queue holds are tuples: the symbol (its priority), the suffix's place, the symbols before it packed into a word, and the
common prefix with the tuple that was handed in to the same symbol before. So a tuple that is taken says by itself whether and where
it hands in the next one; the text is read only when its word is used up. Common prefixes are carried, and are counted in bytes of
the first text at every level: of two suffixes handed in to one symbol it is the symbol's own length plus the least value met
between those that handed them in. Only where two symbols, or a symbol's L and S suffixes, meet are texts compared. Values stop
at `cap`, so the least value since any moment is a look-up in a table of cap + 1 moments. In the naming pass the same values,
capped at 1, say which substrings are equal.

Queues are on disk. How many tuples each symbol will get is counted beforehand; the symbols are cut into spans of a bounded number
of tuples; those for later spans are appended to their span's file, and only the present span is in memory, as a run for each
symbol. Everything else whose size is that of the text is a mapped file, written and read in runs, or sorted by spans in the same
way. Memory is bounded by Store's `memory` whatever the text's length. The files lie in a folder of the task's own, as Spark's spill
files do: nothing else reads them, and they are unlinked as soon as they are open. A run of one symbol is handed in as a whole.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

RECORD = np.dtype([("key", "<i8"), ("sym", "<i8"), ("pos", "<i8"), ("pre", "<u8"), ("val", "u1")])
FEW, WAVES = 512, 16  # a run of one symbol is expanded at once from a wave of so few tuples on, after so many waves


class Store:
    """Arrays in memory, or in files of a temporary folder when they are large: all together some `memory` bytes in memory."""

    def __init__(self, memory: int = 64 << 20):
        self.memory, self.folder, self.n = memory, None, 0
        self.span = max(64, memory // 192)  # tuples of a span
        self.chunk = max(64, memory // 1024)  # tuples handled at once

    def path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="suffixes-")
        self.n += 1
        return os.path.join(self.folder, f"{self.n}")

    def array(self, size: int, kind=np.int64, fill: int = 0) -> np.ndarray:
        if size * np.dtype(kind).itemsize <= self.memory // 32:
            return np.full(size, fill, kind)
        path = self.path()
        out = np.memmap(path, kind, "w+", shape=(size,))
        os.unlink(path)  # the space returns with the array
        for i in range(0, size if fill else 0, self.chunk):
            out[i : i + self.chunk] = fill
        return out

    def file(self):
        path = self.path()
        f = open(path, "w+b", buffering=1 << 12)
        os.unlink(path)
        return f

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def records(key, sym, pos, pre, val) -> np.ndarray:
    out = np.empty(len(pos), RECORD)
    for name, x in zip(RECORD.names, (key, sym, pos, pre, val)):
        out[name] = x
    return out


class KeySort:
    """add(records) in any order, then drain() in order of their distinct keys below `size`, a span of keys at a time."""

    def __init__(self, store: Store, size: int):
        self.store, self.one, self.files, self.held = store, size <= store.span, {}, []

    def add(self, r: np.ndarray) -> None:
        if self.one:
            self.held.append(r)
            return
        of = r["key"] // self.store.span
        order = np.argsort(of, kind="stable")
        r, of = r[order], of[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]).tolist() if len(of) else []
        for a, b in zip(starts, [*starts[1:], len(of)]):
            k = int(of[a])
            if k not in self.files:
                self.files[k] = self.store.file()
            self.files[k].write(r[a:b].tobytes())

    def drain(self) -> Iterator[np.ndarray]:
        if self.one:
            spans = [np.concatenate(self.held)] if self.held else []
            self.held = []
        else:
            spans = (_read(self.files.pop(k)) for k in sorted(self.files))
        for r in spans:
            yield r[np.argsort(r["key"], kind="stable")]


def _read(f) -> np.ndarray:
    f.seek(0)
    out = np.fromfile(f, RECORD)
    f.close()
    return out


def run_ends(s: np.ndarray) -> np.ndarray:
    """Whether each of the sorted values is the last of its kind."""
    out = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=out[:-1])
    return out


class SpanQueue:
    """Tuples by symbol, and of a symbol in order of arrival. counts: how many each symbol will get. One span is open at a time."""

    def __init__(self, store: Store, counts: np.ndarray):
        self.store, self.counts, self.files = store, counts, {}
        self.bounds = [0]
        for lo in range(0, len(counts), store.span):  # no span has too many symbols either
            part, used = np.cumsum(counts[lo : lo + store.span]), 0
            while (k := int(np.searchsorted(part, used + store.span, side="right"))) < len(part):
                alone = lo + k == self.bounds[-1]  # a symbol that is too large is a span of its own
                self.bounds.append(lo + k + alone)
                used = int(part[k]) if alone else int(part[k - 1])
            if self.bounds[-1] < lo + len(part):
                self.bounds.append(lo + len(part))
        self.edges = np.array(self.bounds)
        self.lo = self.hi = -1

    @property
    def spans(self) -> int:
        return len(self.bounds) - 1

    def open(self, k: int) -> None:
        self.lo, self.hi = self.bounds[k], self.bounds[k + 1]
        self.start = np.concatenate(([0], np.cumsum(self.counts[self.lo : self.hi])))
        n, self.filled = int(self.start[-1]), np.zeros(self.hi - self.lo, np.int64)
        self.pos = self.pre = self.val = None
        self.pos, self.pre, self.val = self.store.array(n), self.store.array(n, np.uint64), self.store.array(n, np.uint8)
        if f := self.files.pop(k, None):
            f.seek(0)
            while len(r := np.fromfile(f, RECORD, self.store.chunk)):
                order = np.argsort(r["sym"], kind="stable")
                self._put(*(r[c][order] for c in ("sym", "pos", "pre", "val")))
            f.close()

    def _put(self, sym, pos, pre, val) -> None:
        last = np.flatnonzero(run_ends(sym)) + 1
        which, size = sym[last - 1] - self.lo, last.copy()
        size[1:] -= last[:-1]
        at = np.repeat(self.start[which] + self.filled[which] - last + size, size) + np.arange(len(sym))
        self.pos[at], self.pre[at], self.val[at] = pos, pre, val
        self.filled[which] += size

    def push(self, sym, pos, pre, val) -> None:
        """sym in ascending order."""
        if not len(sym):
            return
        if self.lo <= sym[0] and sym[-1] < self.hi:
            self._put(sym, pos, pre, val)
            return
        cut = np.searchsorted(sym, self.edges).tolist()
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            if a < b:
                if self.bounds[k] == self.lo:
                    self._put(sym[a:b], pos[a:b], pre[a:b], val[a:b])
                else:
                    if k not in self.files:
                        self.files[k] = self.store.file()
                    self.files[k].write(records(0, sym[a:b], pos[a:b], pre[a:b], val[a:b]).tobytes())

    def runs(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the tuples of symbols lo .. hi - 1 of the span are, and their symbols."""
        size = self.filled[lo - self.lo : hi - self.lo]
        skip = self.start[lo - self.lo : hi - self.lo] - np.cumsum(size) + size
        sym = np.repeat(np.arange(lo, hi), size)
        return np.repeat(skip, size) + np.arange(len(sym)), sym


class Met:
    """Common prefixes of tuples that are handed in, from those between the tuples that hand them in."""

    def __init__(self, store: Store, symbols: int, cap: int):
        self.cap, self.next = cap, 1
        self.last = store.array(symbols, np.int64, -1)  # when each symbol was last handed in to
        self.recent = np.zeros(cap + 1, np.int64)  # when a value of at most v was last met

    def derive(self, a: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """a: the values met now; at: which of them hand in, sorted by the symbols `to` and then by place."""
        same, out = ~run_ends(to)[:-1], np.zeros(len(to), np.int64)
        if same.any():
            lo, hi = at[:-1][same] + 1, at[1:][same] + 1
            out[1:][same] = range_minima(a, lo, hi)
        first = np.concatenate(([True], ~same))
        before = self.last[to[first]]
        hist = np.searchsorted(self.recent, before, side="right")
        out[first] = np.where(before < 0, 0, np.minimum(hist, np.minimum.accumulate(a)[at[first]]))
        end = run_ends(to)
        self.last[to[end]] = self.next + at[end]
        return out

    def go_on(self, a: np.ndarray) -> None:
        seen = np.full(self.cap + 1, -1)
        seen[a] = self.next + np.arange(len(a))
        self.recent = np.maximum(self.recent, np.maximum.accumulate(seen))
        self.next += len(a)


def range_minima(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of a[lo .. hi - 1]; all ranges have an element."""
    size = hi - lo
    out, k = a[lo].copy(), np.frexp(size)[1] - 1
    row, level, most = a, 0, int(k.max())
    while True:
        m = np.flatnonzero(k == level) if most else slice(None)
        out[m] = np.minimum(row[lo[m]], row[hi[m] - (1 << level)])
        if level == most:
            return out
        h = 1 << level
        row, level = np.minimum(row[:-h], row[h:]), level + 1


class Seeds:
    """Tuples in order, a column in one array each."""

    def __init__(self, store: Store, m: int):
        self.sym, self.pos, self.pre, self.val = (store.array(m, t) for t in (np.int64, np.int64, np.uint64, np.uint8))

    def put(self, at: int, sym, pos, pre, val) -> int:
        n = slice(at, at + len(pos))
        self.sym[n], self.pos[n], self.pre[n], self.val[n] = sym, pos, pre, val
        return n.stop

    def part(self, a: int, n: int) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x[a : a + n]) for x in (self.sym, self.pos, self.pre, self.val))


class Text:
    """The first text. weight: of each symbol, how many bytes it stands for (None: one each)."""

    def __init__(self, store: Store, symbols: np.ndarray, weight: np.ndarray | None):
        self.symbols, self.weight, self.offset = symbols, weight, None
        if weight is not None:
            self.offset, at = store.array(len(symbols) + 1), 0
            for i in range(0, len(symbols), store.chunk):
                w = at + np.cumsum(weight[symbols[i : i + store.chunk]].astype(np.int64))
                self.offset[i + 1 : i + 1 + len(w)] = w
                at = int(w[-1])

    def bytes_at(self, place: np.ndarray) -> np.ndarray:
        return place if self.offset is None else self.offset[place]


class Level:
    """One string of the recursion. t: its symbols; home: places of its symbols in the first text (None: this is the first)."""

    def __init__(self, store: Store, t: np.ndarray, symbols: int, text: Text, home: np.ndarray | None, cap: int):
        self.store, self.t, self.symbols, self.n = store, t, symbols, len(t)
        self.text, self.home, self.cap = text, home, cap
        self.bits = max(1, int(symbols - 1).bit_length())
        self.per = 63 // self.bits
        self.mask = np.uint64((1 << self.bits) - 1)
        self.shift = np.uint64(self.bits)
        self.large, self.small, self.seeds = (store.array(symbols) for _ in range(3))
        self.weight = text.weight  # of a symbol: bytes of the first text, up to cap
        if home is not None:
            self.weight = store.array(symbols, np.uint8)
            for i in range(0, self.n, store.chunk):
                s, at = t[i : i + store.chunk], np.asarray(home[i : i + store.chunk + 1])
                ends = np.append(at[1:], len(text.symbols))[: len(s)]
                self.weight[s] = np.minimum(text.bytes_at(ends) - text.bytes_at(at[: len(s)]), cap)

    def before(self, pos: np.ndarray) -> np.ndarray:
        """The symbols before each place, nearest lowest, under a one that ends them."""
        n = np.minimum(pos, self.per)
        out = np.left_shift(np.uint64(1), (n * self.bits).astype(np.uint64))
        for k in range(self.per):
            ok = n > k
            if ok.all():
                out |= self.t[pos - 1 - k].astype(np.uint64) << np.uint64(k * self.bits)
            else:
                out[ok] |= self.t[pos[ok] - 1 - k].astype(np.uint64) << np.uint64(k * self.bits)
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes of the first text that the suffixes at a and b share, up to cap."""
        if self.home is not None:
            a, b = self.home[a], self.home[b]
        text, n, reach = self.text.symbols, len(self.text.symbols), np.arange(16)
        most = np.minimum(n - np.maximum(a, b), self.cap)
        out, live, k = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        while len(live):
            x, y = (np.minimum((z[live] + k)[:, None] + reach, n - 1) for z in (a, b))
            other = text[x] != text[y]
            same = np.where(other.any(axis=1), other.argmax(axis=1), 16)
            k += 16
            out[live] += same
            live = live[(same == 16) & (most[live] > k)]
        out = np.minimum(out, most)
        return np.minimum(self.text.bytes_at(a + out) - self.text.bytes_at(a), self.cap)

    def count(self) -> int:
        """Count the symbols' L and S suffixes and seeds; returns the number of seeds."""
        total = 0
        for small, lo in self._types():
            s = self.t[lo : lo + len(small)]
            seed = self._seeds(small, lo)
            for into, which in ((self.large, ~small), (self.small, small), (self.seeds, seed)):
                self._tally(into, s[which])
            total += int(seed.sum())
        return total

    def _tally(self, into: np.ndarray, s: np.ndarray) -> None:
        if self.symbols <= self.store.chunk:
            into[: self.symbols] += np.bincount(s, minlength=self.symbols)
        else:
            u, n = np.unique(s, return_counts=True)
            into[u] += n

    def _types(self) -> Iterator[tuple[np.ndarray, int]]:
        """(whether suffixes are S, where they begin), chunk by chunk from the end. The text ends before any symbol."""
        after, small_after, step = -1, False, self.store.chunk
        for lo in reversed(range(0, self.n, step)):
            s = np.append(self.t[lo : lo + step].astype(np.int64), after)
            sign = np.sign(np.diff(s))
            m = len(sign)
            differs = np.where(sign != 0, np.arange(m), m)
            near = np.minimum.accumulate(differs[::-1])[::-1]  # equal symbols share the type of the one after them
            small = np.append(sign > 0, small_after)[near]
            yield small, lo
            after, small_after = int(s[0]), bool(small[0])

    def _seeds(self, small: np.ndarray, lo: int) -> np.ndarray:
        left = np.empty(len(small), np.int64)
        left[1:] = self.t[lo : lo + len(small) - 1]
        left[0] = self.t[lo - 1] if lo else -1
        return small & (left > self.t[lo : lo + len(small)])

    def seeds_by_symbol(self, m: int) -> Seeds:
        """Seeds in order of their symbols."""
        q, out, at = SpanQueue(self.store, self.seeds), self._table(m), 0
        if q.spans == 1:
            q.open(0)
        for small, lo in self._types():
            pos = np.flatnonzero(self._seeds(small, lo)) + lo
            sym = self.t[pos].astype(np.int64)
            order = np.argsort(sym, kind="stable")
            pos, sym = pos[order], sym[order]
            q.push(sym, pos, self.before(pos), np.ones(len(pos), np.uint8))
        for k in range(q.spans):
            if q.spans > 1:
                q.open(k)
            for i in range(0, len(q.pos), self.store.chunk):
                p = slice(i, min(i + self.store.chunk, len(q.pos)))
                sym = q.lo + np.searchsorted(q.start, np.arange(p.start, p.stop), side="right") - 1
                at = out.put(at, sym, q.pos[p], q.pre[p], q.val[p])
        return out

    def _table(self, m: int) -> Seeds:
        return Seeds(self.store, m)

    def run_before(self, pos: int, symbol: int) -> int:
        """How many symbols before pos are the given one."""
        n, step = 0, 1 << 10
        while pos:
            part = self.t[max(0, pos - step) : pos]
            other = np.flatnonzero(part != symbol)
            if len(other):
                return n + len(part) - 1 - int(other[-1])
            n, pos, step = n + len(part), pos - len(part), min(2 * step, self.store.chunk)
        return n


Emit = Callable[[np.ndarray, np.ndarray, np.ndarray], None]


class Inducing:
    """Both passes over one level from its seeds in order. Values are common prefixes up to cap; naming: equal (1) or not (0)."""

    def __init__(self, level: Level, seeds: Seeds, naming: bool):
        self.v, self.seeds, self.naming, self.store = level, seeds, naming, level.store
        self.cap = 1 if naming else level.cap
        self.queue = SpanQueue(self.store, level.large)

    def start(self, up: bool) -> None:
        self.up, self.met = up, Met(self.store, self.v.symbols, self.cap)
        self.seen = (-1, -1, False)  # the tuple met last: place, symbol, whether it is S

    def meet(self, sym, small, pos, pre, val, own: bool = True) -> np.ndarray:
        """Take tuples in order and hand in those before them. own: also to the symbol itself. Returns the values met."""
        v, m = self.v, len(pos)
        self.to = to = (pre & v.mask).astype(np.int64)
        if not m:
            return val
        shared = val.astype(np.int64)
        edge = np.empty(m, bool)
        edge[1:] = (sym[1:] != sym[:-1]) | (small[1:] != small[:-1])
        edge[0] = sym[0] != self.seen[1] or bool(small[0]) != self.seen[2]
        at = np.flatnonzero(edge)
        shared[at] = 0
        if not self.naming:
            if v.home is None:  # different symbols share nothing
                before = np.where(at > 0, sym[at - 1], self.seen[1])
                at = at[before == sym[at]]
            at = at[(at > 0) | (self.seen[0] >= 0)]
            if len(at):
                shared[at] = v.common(np.where(at > 0, pos[at - 1], self.seen[0]), pos[at])
        a = shared.astype(np.uint8)
        if self.up:
            hands = (pos > 0) & ((to > sym) | small | (to == sym if own else False))
        else:
            hands = (pos > 0) & ((to < sym) | (small & (to == sym) if own else False))
        x = np.flatnonzero(hands)
        if len(x):
            s = to[x]
            order = np.argsort(s, kind="stable")
            x, s = x[order], s[order]
            new = self.met.derive(a, x, s)
            if not self.naming:
                new += v.weight[s] if v.weight is not None else 1
                np.minimum(new, self.cap, out=new)
            p, w = pos[x] - 1, pre[x] >> v.shift
            if (out := np.flatnonzero((w == 1) & (p > 0))).size:
                w[out] = v.before(p[out])
            self.q.push(s, p, w, new.astype(np.uint8))
        self.met.go_on(a)
        self.seen = (int(pos[-1]), int(sym[-1]), bool(small[-1]))
        return a

    def waves(self, c: int, small: bool, each) -> None:
        """Take all tuples of symbol c in the queue; it may hand in to itself. each(pos, pre, a) sees them in order."""
        q, begin, n_waves, chunk = self.q, 0, 0, self.store.chunk
        s = int(q.start[c - q.lo])
        while begin < (end := int(q.filled[c - q.lo])):
            n_waves += 1
            expand = end - begin <= FEW and n_waves > max(WAVES, self.cap)
            first = begin
            while begin < end:
                hi = min(end, begin + chunk)
                i = slice(s + begin, s + hi)
                pos, pre, val = np.array(q.pos[i]), np.array(q.pre[i]), np.array(q.val[i])
                a = self.meet(np.full(hi - begin, c), np.full(hi - begin, small), pos, pre, val, own=not expand)
                q.val[i] = a
                each(pos, pre, a)
                begin = hi
            if expand:
                i = slice(s + first, s + end)
                for pos, val in self.expanded(c, np.array(q.pos[i]), np.array(q.val[i])):
                    n = int(q.filled[c - q.lo])
                    i = slice(s + n, s + n + len(pos))
                    pre = self.v.before(pos)
                    q.pos[i], q.pre[i], q.val[i] = pos, pre, val
                    q.filled[c - q.lo] = n + len(pos)
                    q.val[i] = a = self.meet(np.full(len(pos), c), np.full(len(pos), small), pos, pre, val, own=False)
                    each(pos, pre, a)
                return

    def expanded(self, c: int, pos: np.ndarray, val: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, values) of all that a wave's tuples still hand in to their own symbol, wave by wave."""
        left = np.array([self.v.run_before(p, c) for p in pos.tolist()], np.int64)
        done = 0
        for stop in np.unique(left[left > 0]).tolist():
            here = np.flatnonzero(left >= stop)
            if self.naming:  # equal to the one before if all between are; waves differ
                one = np.minimum.reduceat(val[: here[-1] + 1], np.concatenate(([0], here[:-1] + 1)))
                one[0] = 0
            else:  # as many equal symbols come first as there were waves: cap at least
                one = np.full(len(here), self.cap, np.uint8)
            step = max(1, self.store.chunk // len(here))
            for k in range(done + 1, stop + 1, step):
                ks = np.arange(k, min(stop + 1, k + step))
                yield (pos[here][None, :] - ks[:, None]).ravel(), np.tile(one, len(ks))
            done = stop

    def ascend(self) -> None:
        """All L suffixes in order: self.pos, self.pre and self.val."""
        v, q, chunk = self.v, self.queue, self.store.chunk
        self.q, total = q, int(sum(int(v.large[i : i + chunk].sum()) for i in range(0, v.symbols, chunk)))
        self.pos, self.pre, self.val = self.store.array(total), self.store.array(total, np.uint64), self.store.array(total, np.uint8)
        self.start(True)
        last = np.array([v.n - 1])
        if q.spans == 1:
            q.open(0)
        q.push(v.t[last].astype(np.int64), last, v.before(last), np.zeros(1, np.uint8))  # before all others of its symbol
        self.met.last[int(v.t[v.n - 1])] = 0
        done = taken = 0  # of L suffixes, and of seeds
        seeds, none = self.seeds, lambda *_: None
        for k in range(q.spans):
            if q.spans > 1:
                q.open(k)
            c, step = q.lo, 64
            while c < q.hi:
                hi = min(q.hi, c + step)
                n = int(q.filled[c - q.lo : hi - q.lo].sum())
                m = int(np.searchsorted(seeds.sym[taken : taken + chunk], hi))
                if n + m > chunk // 2 and hi > c + 1:
                    step = max(1, step // 4)
                    continue
                if not n + m:
                    c, step = hi, min(v.symbols, step * 4)
                    continue
                end = c
                if n + m <= chunk // 2:
                    at, sym = q.runs(c, hi)
                    got = seeds.part(taken, m)
                    both = np.concatenate((sym, got[0]))
                    order = np.argsort(both, kind="stable")  # of a symbol, the L suffixes come before the seeds
                    both = both[order]
                    small = order >= n
                    pos, pre, val = (np.concatenate(x)[order] for x in ((q.pos[at], got[1]), (q.pre[at], got[2]), (q.val[at], got[3])))
                    to = (pre & v.mask).astype(np.int64)
                    to[(pos == 0) | (~small & (to < both))] = v.symbols
                    # the longest run of symbols c .. end - 1 that hands in nothing below end
                    last = np.flatnonzero(run_ends(both))
                    least, of = np.minimum.accumulate(to)[last], both[last]
                    bad = least < np.append(of[1:], hi)
                    b = int(bad.argmax())
                    end = max(int(least[b]), int(of[b])) if bad[b] else hi
                if end > c:
                    n = int(np.searchsorted(both, end))
                    a = self.meet(both[:n], small[:n], pos[:n], pre[:n], val[:n])
                    large = order[:n] < len(at)
                    q.val[at[order[:n][large]]] = a[large]
                    taken += int(n - large.sum())
                    c, step = end, min(v.symbols, max(16, 2 * (end - c + 1)))
                else:
                    self.waves(c, False, none)
                    while True:
                        m = int(np.searchsorted(seeds.sym[taken : taken + chunk // 2], c + 1))
                        if not m:
                            break
                        _, pos, pre, val = seeds.part(taken, m)
                        self.meet(np.full(m, c), np.ones(m, bool), pos, pre, val)
                        taken += m
                    c, step = c + 1, 16
            for i in range(0, len(q.pos), chunk):
                p = slice(done + i, done + min(i + chunk, len(q.pos)))
                self.pos[p], self.pre[p], self.val[p] = (x[i : i + chunk] for x in (q.pos, q.pre, q.val))
            done += len(q.pos)

    def descend(self, emit: Emit) -> None:
        """emit(places, common prefixes with the one emitted before, whether seeds) of all suffixes, from the last to the first."""
        v, chunk = self.v, self.store.chunk
        self.queue = None
        self.q = q = SpanQueue(self.store, v.small)
        self.start(False)
        left = len(self.pos)  # L suffixes not yet taken
        if q.spans == 1:
            q.open(0)

        def told(sym, small, pos, a):
            if len(pos):
                emit(pos, a, small & (self.to > sym) & (pos > 0))

        def each(pos, pre, a):
            emit(pos, a, (self.to > c - 1) & (pos > 0))

        for k in reversed(range(q.spans)):
            if q.spans > 1:
                q.open(k)
            c, step = q.hi, 64
            while c > q.lo:
                lo = max(q.lo, c - step)
                n = int(q.filled[lo - q.lo : c - q.lo].sum())
                m = int(v.large[lo:c].sum())
                if n + m > chunk // 2 and lo < c - 1:
                    step = max(1, step // 4)
                    continue
                if not n + m:
                    c, step = lo, min(v.symbols, step * 4)
                    continue
                end = c
                if n + m <= chunk // 2:
                    at, sym = q.runs(lo, c)
                    sym_l = np.repeat(np.arange(lo, c), v.large[lo:c])
                    part = slice(left - m, left)
                    # from behind: of a symbol, the S suffixes in order of arrival, then the L suffixes from the last
                    both = np.concatenate((sym, sym_l[::-1]))
                    order = np.argsort(-both, kind="stable")
                    both, small = both[order], order < n
                    pos, pre, val = (np.concatenate((x[at], y[part][::-1]))[order] for x, y in ((q.pos, self.pos), (q.pre, self.pre), (q.val, self.val)))
                    # an L suffix's value is with the one before it: it moves on to that one
                    large = np.flatnonzero(~small)
                    val = self._moved(val, large, part)
                    to = (pre & v.mask).astype(np.int64)
                    to[(pos == 0) | (small & (to > both)) | (~small & (to >= both))] = -1
                    last = np.flatnonzero(run_ends(both))
                    most, of = np.maximum.accumulate(to)[last], both[last]
                    bad = most > np.append(of[1:], lo - 1)
                    b = int(bad.argmax())
                    end = min(int(most[b]), int(of[b])) + 1 if bad[b] else lo
                if end < c:
                    n = int(np.searchsorted(-both, -end, side="right"))
                    a = self.meet(both[:n], small[:n], pos[:n], pre[:n], val[:n])
                    told(both[:n], small[:n], pos[:n], a)
                    left -= int((~small[:n]).sum())
                    c, step = end, min(v.symbols, max(16, 2 * (c - end + 1)))
                else:
                    self.waves(c - 1, True, each)
                    stop = left - int(v.large[c - 1])
                    while left > stop:
                        part = slice(max(stop, left - chunk // 2), left)
                        pos, pre, val = (np.array(x[part][::-1]) for x in (self.pos, self.pre, self.val))
                        val = self._moved(val, np.arange(len(pos)), part)
                        sym, small = np.full(len(pos), c - 1), np.zeros(len(pos), bool)
                        a = self.meet(sym, small, pos, pre, val)
                        told(sym, small, pos, a)
                        left = part.start
                    c, step = c - 1, 16

    def _moved(self, val: np.ndarray, large: np.ndarray, part: slice) -> np.ndarray:
        """Values of L suffixes taken from behind: each gets that of the one taken before it, which it shares."""
        if len(large):
            ahead = int(self.val[part.stop]) if part.stop < len(self.val) else 0
            val = val.copy()
            val[large[1:]] = val[large[:-1]].copy()
            val[large[0]] = ahead
        return val


def _order_in_memory(store: Store, level: Level, emit: Emit) -> None:
    """The same for a string of names that fits in a span: sorted by prefixes of doubled lengths, up to cap symbols."""
    n, h = level.n, 1
    rank = np.array(level.t, np.int64)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - h)] = rank[h:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank[order] = np.cumsum(fresh) - 1
        h *= 2
        if fresh.all() or h >= level.cap:
            break
    order = order[::-1]
    for i in range(0, n, store.chunk):
        pos = order[i : i + store.chunk]
        a = level.common(order[max(0, i - 1) : i + len(pos) - 1], pos if i else pos[1:])
        emit(pos, (a if i else np.append(0, a)).astype(np.uint8), np.zeros(len(pos), bool))


def _order(store: Store, level: Level, emit: Emit) -> None:
    """emit all suffixes of a level from the last to the first, with their common prefixes."""
    if level.home is not None and level.n <= store.span:
        _order_in_memory(store, level, emit)
        return
    chunk = store.chunk
    m = level.count()
    seeds = level.seeds_by_symbol(m)
    if m > 1:
        named, state = KeySort(store, level.n), {"name": 0, "zeros": 0, "last": -1, "rank": 0}

        def name(pos, a, seed):
            """Names count from the last; a new one begins where something differs from the seed before."""
            zeros = state["zeros"] + np.cumsum(a == 0)
            state["zeros"] = int(zeros[-1])
            z, p = zeros[seed], pos[seed]
            if len(z):
                fresh = np.append(z[:1] != state["last"], z[1:] != z[:-1])
                ids = state["name"] + np.cumsum(fresh)
                state["name"], state["last"] = int(ids[-1]), int(z[-1])
                named.add(records(p, ids, state["rank"] + np.arange(len(p)), 0, 0))
                state["rank"] += len(p)

        x = Inducing(level, seeds, True)
        x.ascend()
        x.descend(name)
        del x, seeds
        names, at, home, i = state["name"], store.array(m), store.array(m), 0
        order = KeySort(store, m)
        t = store.array(m, np.int32 if names < 1 << 31 else np.int64)
        for r in named.drain():
            n = slice(i, i + len(r))
            at[n], t[n] = r["key"], names - r["sym"]
            home[n] = r["key"] if level.home is None else level.home[r["key"]]
            if names == m:  # all differ: their order is the seeds'
                order.add(records(m - 1 - r["pos"], 0, np.arange(i, i + len(r)), 0, 0))
            i += len(r)
        below = KeySort(store, m)
        if names < m:
            count = {"n": 0}

            def rank(pos, a, _):
                """From the last: rank m - 1 - k, and the value is the next rank's."""
                below.add(records(pos, 0, m - 1 - count["n"] - np.arange(len(pos)), 0, a))
                count["n"] += len(pos)

            _order(store, Level(store, t, names, level.text, home, level.cap), rank)
        else:
            for r in order.drain():
                below.add(records(r["pos"], 0, r["key"], 0, 0))
        del t, home, order
        ranked, held = KeySort(store, m), 0
        for r in below.drain():  # by place in the string of names: the seeds in the order of the text
            pos = np.asarray(at[held : held + len(r)])
            held += len(r)
            ranked.add(records(r["pos"], level.t[pos], pos, level.before(pos), r["val"]))
        seeds, i, prev = level._table(m), 0, None
        for r in ranked.drain():
            if names == m:
                a = np.concatenate(([r["pos"][0] if prev is None else prev], r["pos"][:-1]))
                r["val"] = level.common(a, r["pos"])
                prev = r["pos"][-1]
            i = seeds.put(i, r["sym"], r["pos"], r["pre"], r["val"])
        if names < m:  # of a rank and the next: moves on to the next
            carry = 0
            for i in range(0, m, chunk):
                v = np.array(seeds.val[i : i + chunk])
                seeds.val[i : i + chunk] = np.concatenate(([carry], v[:-1]))
                carry = v[-1]
        del at, below, ranked
    x = Inducing(level, seeds, False)
    x.ascend()
    x.descend(emit)


def order_suffixes(text: np.ndarray, store: Store, cap: int, emit: Emit, weight: np.ndarray | None = None) -> None:
    """emit(places, bytes in common with the suffix emitted before, up to cap (254 at most), ...) from the last suffix to the first.

    text: bytes or, with their weights (unsigned, 8 bits), any symbols from 0. It may be a mapped file.
    """
    if len(text):
        _order(store, Level(store, text, 256 if weight is None else len(weight), Text(store, text, weight), None, cap), emit)


def sort_suffixes(text: np.ndarray, store: Store, cap: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of bytes, and each suffix's common prefix with the one before it, up to cap. For texts that fit in memory."""
    got: list[tuple] = []
    order_suffixes(text, store, cap, lambda pos, a, _: got.append((np.array(pos), np.array(a))))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pos, a = (np.concatenate(x) for x in zip(*got))
    return pos[::-1], np.append(0, a[1:][::-1]).astype(np.int64)
