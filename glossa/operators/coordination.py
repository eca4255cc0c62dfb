"""Coordination: similarity of phrases, the scope of a coordination key by alignment, relations of scopes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np

NEAR, BOUNDARY, STRONG = 1.0, 7.0, 3.9


@dataclass(frozen=True)
class Item:
    """level orders how strongly a phrase ends a clause, from 0, -1 where it ends none; particles are its function words."""

    head: str
    predicate: bool = False
    kind: str = ""
    unit: str = ""
    particles: frozenset[str] = frozenset()
    topic: bool = False
    level: int = -1
    codes: tuple[tuple[str, ...], ...] = ()


def code_score(a: Item, b: Item) -> float:
    best = 0.0
    for x in a.codes:
        for y in b.codes:
            common = 0
            while common < min(len(x), len(y)) and x[common] == y[common]:
                common += 1
            best = max(best, 2 * common / (len(x) + len(y)))
    return best


def affinity(a: Item, b: Item) -> float:
    """How alike two phrases are; 0 unless both are predicates or both nominal."""
    if a.predicate != b.predicate:
        return 0.0
    score = 2.0
    names = {"person", "place", "organisation"}
    if a.kind == "quantity" == b.kind:
        score += 2 + (5 if a.unit == b.unit else 0)
    elif a.kind in names and b.kind in names:
        score += 5 if a.kind == b.kind else 2
    elif a.head == b.head:
        score += 10
    else:
        tail = 0
        while tail < min(len(a.head), len(b.head)) and a.head[-1 - tail] == b.head[-1 - tail]:
            tail += 1
        score += min(10.0, 2 * code_score(a, b) * 7 + (2.0 * tail if tail > 1 else 0.0))
    return score + 2 * len(a.particles & b.particles) + (3 if a.topic and b.topic else 0)


def boundary(key_level: int, level: int) -> float:
    """The penalty for a scope to pass a phrase that ends a clause at least as strongly as the key."""
    return BOUNDARY * (level - key_level + 1) if level >= max(key_level, 0) else 0.0


@dataclass(frozen=True)
class Scope:
    start: int
    key: int
    end: int
    score: float
    path: tuple[tuple[int, int], ...]
    status: str


NAMES = ("person", "place", "organisation")
WHOLE = 8192  # phrases of a sentence whose affinities are held at once
FEW = 40  # places of a key's short side up to which every one is aligned
NEARBY = 24  # phrases on each side of a key among which a first score is looked for
TOGETHER = 12  # keys that are bounded together
HELD = 1 << 16  # numbers of an anti-diagonal that are worked on at once
RUN = 12  # phrases of a run, on average, from which runs are worked on as such
SHORT = 128  # phrases of a sentence up to which it is aligned with others
LOW = -(1 << 29)
SLACK = 1e-4
#: Intervals of lengths are cut at these parts and multiples of the length of the best scope so far: narrow where a scope may come near it.
CUTS = (0.02, 0.06, 0.15, 0.3, 0.5, 0.7, 0.84, 0.93, 0.98, 1.02, 1.07, 1.16, 1.35, 1.75, 2.5, 4, 7, 12, 24, 50, 100, 250, 600, 1500, 4000)


class Marks:
    """What affinity reads of phrases, one after another, as numbers. Words that end alike have the same number for each length of
    what they share; a word shorter than that has one of its own."""

    def __init__(self, heads: Sequence[str], codes: np.ndarray, predicate: np.ndarray, level: np.ndarray) -> None:
        """heads are the different words, codes their places for each phrase."""
        self.ends = np.empty((4, len(codes)), np.int32)
        for k, row in enumerate(self.ends, 2):
            known: dict = {}
            row[:] = np.array([known.setdefault(w[-k:] if len(w) >= k else (w,), len(known)) for w in heads], np.int32)[codes] if len(codes) else 0
        self.predicate, self.level = predicate, level
        self.quantity: np.ndarray | None = None
        self.particles: np.ndarray | None = None
        self.topic: np.ndarray | None = None

    @classmethod
    def of(cls, items: Sequence[Item]) -> Marks | None:
        """None where affinities need not be integers."""
        if any(x.codes for x in items):
            return None
        known: dict[str, int] = {}
        codes = np.array([known.setdefault(x.head, len(known)) for x in items], np.intp)
        out = cls(list(known), codes, np.array([x.predicate for x in items], bool), np.array([x.level for x in items], np.int32))
        if any(x.kind for x in items):
            ids = lambda values: np.array([known.setdefault(v, len(known)) for known in ({},) for v in values])
            out.quantity, out.name = np.array([x.kind == "quantity" for x in items]), np.array([x.kind in NAMES for x in items])
            out.kind, out.unit = ids(x.kind for x in items), ids(x.unit for x in items)
        words = sorted(set().union(*(x.particles for x in items)))
        if words:
            out.particles = np.array([[w in x.particles for w in words] for x in items], np.int16)
        if any(x.topic for x in items):
            out.topic = np.array([x.topic for x in items], np.int16)
        return out

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """affinity of phrases a and b, both places."""
        same = lambda values: values[a] == values[b]
        score = 2 * same(self.ends[0]).astype(np.int16)
        for row in self.ends[1:]:
            score += same(row)
        score *= 2
        if self.quantity is not None:
            score = np.where(self.name[a] & self.name[b], np.where(same(self.kind), 5, 2), score).astype(np.int16)
            score = np.where(self.quantity[a] & self.quantity[b], np.where(same(self.unit), 7, 2), score).astype(np.int16)
        score += 2
        if self.particles is not None:
            score += 2 * np.einsum("...w,...w->...", self.particles[a], self.particles[b])
        if self.topic is not None:
            score += 3 * self.topic[a] * self.topic[b]
        score *= same(self.predicate)
        return score

    def cuts(self, begin: int, n: int) -> np.ndarray:
        """Where, counted from begin, a phrase is not to affinity and cost what the one before it is."""
        rows = [*self.ends, self.predicate, self.level]
        rows += [self.quantity, self.name, self.kind, self.unit] if self.quantity is not None else []
        rows += [] if self.particles is None else list(self.particles.T)
        rows += [] if self.topic is None else [self.topic]
        new = np.zeros(max(0, n - 1), bool)
        for row in rows:
            new |= row[begin + 1 : begin + n] != row[begin : begin + n - 1]
        return np.flatnonzero(new) + 1


def cost_of(level: np.ndarray, key_level: int) -> np.ndarray:
    """What a phrase costs that is skipped after a key of this level; one before the key costs as much, but NEAR less where it is taken."""
    return (np.where(level >= max(key_level, 0), int(BOUNDARY) * (level - key_level + 1), 0) + int(NEAR)).astype(np.int32)


def rising(rows: int, columns: int, first: np.ndarray, gains: Callable[[int, int, int], Iterable[tuple[int, int, np.ndarray]]]) -> Iterator[np.ndarray]:
    """Best sums over rising chains of cells, by anti-diagonals: after step d, place p holds the best chain in the first p rows and d - p
    columns above what `first` has for the rows left out at the top. gains(d, low, high) gives what cells of rows low - 1 to high - 2
    add on diagonal d, in parts (from, to, values)."""
    last, now, sums = first.copy("K"), first.copy("K"), np.empty_like(first)
    for d in range(rows + columns + 1):
        low, high = max(1, d - columns), min(rows + 1, d)
        if low < high:
            for a, b, gain in gains(d, low, high):
                np.add(last[a - 1 : b - 1], gain, out=sums[a:b])
            np.maximum(sums[low:high], now[low:high], out=last[low:high])
            np.maximum(last[low:high], now[low - 1 : high - 1], out=last[low:high])
        last, now = now, last
        yield now


def _windows(a: np.ndarray, width: int) -> np.ndarray:
    """The maximum of each window of a width, along the second axis."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a, have = np.maximum(a[:, :-step], a[:, step:]), have + step
    return a


def even_block(top: np.ndarray, left: np.ndarray, gain: int) -> tuple[np.ndarray, np.ndarray]:
    """Best sums along the bottom and the right side of a block whose cells all add the same, from those along its top and its left side, of
    several sweeps. A chain that enters at a place of these sides takes as many cells as the shorter way to the end allows."""
    m, c = left.shape[1] - 1, top.shape[1] - 1
    border = np.concatenate([left[:, :0:-1], top], axis=1)  # from the lower left corner to the upper right one
    at = np.arange(-m, c + 1, dtype=np.int32)
    high = border + gain * np.minimum(at, 0)  # where rows are fewer than columns
    wide = border - gain * np.maximum(at, 0)
    down, across = np.arange(m + 1, dtype=np.int32) * gain, np.arange(c + 1, dtype=np.int32) * gain
    bottom = np.maximum(np.maximum.accumulate(high[:, : c + 1], axis=1) + down[m], _windows(wide, m + 1) + across)
    right = np.maximum(_windows(high, c + 1)[:, ::-1] + down, np.maximum.accumulate(wide[:, : c - 1 if c else None : -1], axis=1) + across[c])
    return bottom, right


class Grid:
    """The phrases of a sentence and the best scope of a key by numbers: scope's answer without its path.

    All costs are integers, so sums do not depend on their order. With the costs of skipping added up beforehand, an alignment is a
    chain of pairs, and the pairs of a sentence weigh the same for all its keys of a level. So the chains of several keys, and of several ends or
    starts of each, are found in one sweep over the anti-diagonals: an addition and two maxima for all of them.

    A key's side with fewer phrases is its short side. Where that is longer than FEW, not every place of it is aligned. Within an interval of
    lengths a chord lies below the root, and is a sum of what a start and what an end give; so one sweep bounds, for every place of
    the short side, what any scope of those lengths from there has above a score already found. Places whose bound is below zero in all
    intervals are not the best; all others are aligned with every place of the other side.
    """

    def __init__(self, marks: Marks, begin: int, n: int) -> None:
        self.marks, self.begin, self.n = marks, begin, n
        self.level = marks.level[begin : begin + n]
        self.table: np.ndarray | None = None
        self.root = np.array([k**0.5 for k in range(n + 2)])
        self.cuts = marks.cuts(begin, n)

    @classmethod
    def of(cls, items: Sequence[Item]) -> Grid | None:
        """None where affinities need not be integers."""
        marks = Marks.of(items)
        return marks and cls(marks, 0, len(items))

    def _diagonal(self, d: int, first: int, last: int) -> np.ndarray:
        """affinity of (i, d - i) for i from first to last - 1, i < d - i."""
        if self.table is None and self.n <= WHOLE:
            n = self.n
            ds = np.arange(2 * n)
            low = np.maximum(0, ds - n + 1)
            sizes = np.maximum((ds + 1) // 2 - low, 0)
            self.offset = (np.r_[0, sizes.cumsum()[:-1]] - low).tolist()
            offset = np.array(self.offset)
            self.table = np.zeros(int(sizes.sum()), np.int16)
            for i in range(0, n, 64):
                a, b = np.arange(i, min(n, i + 64))[:, None], np.arange(i + 1, n)[None, :]
                some = self.marks.pair(self.begin + a, self.begin + b)
                ok = a < b
                self.table[(offset[a + b] + a)[ok]] = some[ok]
        if self.table is not None:
            at = self.offset[d]
            return self.table[at + first : at + last]
        a = np.arange(first, last)
        return self.marks.pair(self.begin + a, self.begin + d - a)

    def _sweep(self, keys: np.ndarray, low: int, n: int, mirrored: bool, entries: Sequence[np.ndarray]) -> list[np.ndarray]:
        """For each pair of keys (first, last) and its entries, one for each number of phrases taken before the last key (mirrored: after the
        first one), counted from there: the best sum of an entry and a chain from there, by the number of phrases after the first key (mirrored:
        before the last one). The chain may take phrases before the last key and phrases after the first. Phrases before low and from n on do not count."""
        rise = self._rise
        at, open_at = ((n - 1 - keys[:, 0]), (n - 1 - keys[:, 1])) if mirrored else (keys[:, 1] - low, keys[:, 0] - low)
        rows, base = int(at.max()), int(open_at.min())
        columns, width = n - low - 1 - base, rows - base
        first = np.full((len(keys), rows + 1), LOW, np.int32)
        for one, k, entry in zip(first, at.tolist(), entries, strict=True):
            held = np.maximum.accumulate(entry[k::-1] if len(entry) > k else entry[::-1])
            one[k + 1 - len(held) : k + 1] = held
            one[k + 1 :] = held[-1]
        first = first.T
        mask = (rows - np.arange(width)[:, None] > open_at[None, :]).astype(np.int32)
        size = self.n

        def gains(d: int, a: int, b: int) -> Iterator[tuple[int, int, np.ndarray]]:
            view = d - 1 + base
            top = min(b - 1, (view + 1) // 2)  # rows before that are before their column
            diagonal, shift = (2 * (n - 1) - view, n - 1 - view) if mirrored else (view + 2 * low, low)
            gain = np.zeros(b - a, np.int32)
            if top > a - 1:
                i, j = a - 1 + shift, top + shift
                gain[: top - a + 1] = self._diagonal(diagonal, i, j)
                gain[: top - a + 1] += rise[size - 1 - diagonal + i : size - 1 - diagonal + j]
            m = min(b, max(a, d - width))
            if m > a:
                yield a, m, gain[: m - a, None]
            if b > m:
                yield m, b, gain[m - a :, None] * mask[m - (d - width) : b - (d - width)]

        cuts = self.cuts[(self.cuts > low) & (self.cuts < n)]
        if len(cuts) * RUN < n - low:
            return self._sweep_runs(at, open_at, first.T, rows, columns, low, n, mirrored, cuts)
        record = np.empty((rows + columns + 1, len(keys)), np.int32)
        place = at, np.arange(len(keys))
        for d, now in enumerate(rising(rows, columns, first, gains)):
            record[d] = now[place]
        return [record[k + o - base : k + columns + 1, b] for b, (k, o) in enumerate(zip(at.tolist(), open_at.tolist(), strict=True))]

    def _sweep_runs(self, at: np.ndarray, open_at: np.ndarray, side: np.ndarray, rows: int, columns: int, low: int, n: int, mirrored: bool, cuts: np.ndarray) -> list[np.ndarray]:
        """_sweep where phrases come in runs of equal ones: two runs make a block whose cells add the same, and only its sides are worked out.
        Columns that are not open to all keys, and rows that not all have, are taken one by one."""
        base, common, each = int(open_at.min()), int(at.min()), np.arange(len(at))

        def gain(i: Any, j: Any) -> np.ndarray:
            i, j = (n - 1 - j, n - 1 - i) if mirrored else (low + i, low + j)
            i, j = np.broadcast_arrays(i, j)
            return np.where(i < j, self.marks.pair(self.begin + i, self.begin + j) + self._cost[j] + np.int32(NEAR), 0).astype(np.int32)

        early = [side[each, at]]
        for j in range(base + 1, rows + 1):
            taken = side[:, :-1] + gain(np.arange(rows), j) * (j > open_at)[:, None]
            side = side.copy()
            np.maximum(side[:, 1:], taken, out=side[:, 1:])
            np.maximum.accumulate(side, axis=1, out=side)
            early.append(side[each, at])
        cuts = np.sort(n - cuts) if mirrored else cuts - low
        wide = columns - (rows - base)
        top = np.repeat(side[:, :1], wide + 1, axis=1)
        down = [0, *cuts[(cuts > 0) & (cuts < common)].tolist(), common] if common else [0]
        along = [rows + 1, *cuts[(cuts > rows + 1) & (cuts < rows + 1 + wide)].tolist(), rows + 1 + wide] if wide else [rows + 1]
        for i, to in zip(down[:-1], down[1:], strict=True):
            left = side[:, i : to + 1]
            new = np.empty_like(top)
            new[:, 0] = left[:, -1]
            for j, end in zip(along[:-1], along[1:], strict=True):
                x, y = j - rows - 1, end - rows - 1
                bottom, left = even_block(top[:, x : y + 1], left, int(gain(i, j)))
                new[:, x : y + 1] = bottom
            top = new
        late: list = [None] * len(at)
        for p in range(common, rows + 1):
            if p > common:
                taken = top[:, :-1] + gain(p - 1, np.arange(rows + 1, rows + 1 + wide))
                top = top.copy()
                np.maximum(top[:, 1:], taken, out=top[:, 1:])
                top[:, 0] = side[:, p]
                np.maximum.accumulate(top, axis=1, out=top)
            for b in np.flatnonzero(at == p).tolist():
                late[b] = top[b, 1:]
        before = np.array(early)
        return [np.r_[before[o - base :, b], late[b]] for b, o in enumerate(open_at.tolist())]

    def _own(self, key: int, n: int) -> np.ndarray:
        """affinity of the key and each end."""
        return self.marks.pair(np.array([self.begin + key]), self.begin + np.arange(key + 1, n)).astype(np.int64)

    def _settle(self, places: Sequence[tuple[int, int]], low: int, n: int, mirrored: bool, least: float, found: dict[int, tuple[float, int, int, int]]) -> None:
        """All scopes of some keys that have so many phrases before the key, or mirrored so many between the key and the end."""
        sums_before = self._sums
        for few in self._batches(places, low, n):
            keys = np.array([(k, k) for k, _ in few])
            entries = []
            for _, a in few:
                entry = np.full(a + 1, LOW, np.int32)
                entry[a] = 0
                entries.append(entry)
            for (k, a), sums in zip(few, self._sweep(keys, low, n, mirrored, entries), strict=True):
                own = self._owns[k]
                if mirrored:
                    if own[a] <= 0:
                        continue
                    raw = sums[: k - low + 1] + (own[a] + sums_before[k + 1] - sums_before[k + 1 + a]) - (sums_before[k] - sums_before[low : k + 1][::-1])
                else:
                    m = n - 1 - k
                    raw = np.where(own[:m] > 0, sums[:m] + own[:m] - (sums_before[k + 1 : n] - sums_before[k + 1]) - (sums_before[k] - sums_before[k - a]), 0)
                score = np.where(raw > least, raw / self.root[a + 2 : a + 2 + len(raw)], -np.inf)
                at = len(score) - 1 - int(score[::-1].argmax()) if mirrored else int(score.argmax())
                start, end = (k - at, k + 1 + a) if mirrored else (k - a, k + 1 + at)
                one = float(score[at]), start, end, int(raw[at])
                if one[0] > -np.inf and (k not in found or (-one[0], end, start) < (-found[k][0], found[k][2], found[k][1])):
                    found[k] = one

    def _batches(self, places: Sequence, low: int, n: int) -> Iterator[Sequence]:
        k = places[len(places) // 2][0]
        k = k[0] if isinstance(k, tuple) else k
        size = max(1, HELD // (min(k - low, n - 1 - k) + 1))
        for i in range(0, len(places), size):
            yield places[i : i + size]

    def _bounds(self, asked: Sequence[tuple[tuple[int, int], np.ndarray, float, float, float]], n: int, mirrored: bool) -> list[np.ndarray]:
        """For keys from the first to the last of a pair, the most that an end gives by its place, a score and an interval of lengths: by the start, or
        mirrored by the end, the most a scope has above the score times the chord."""
        out: list = [None] * len(asked)
        order = sorted(range(len(asked)), key=lambda i: asked[i][4])
        sums_before = self._sums
        reach = 0
        at = 0
        while at < len(order):
            reach = int(max(asked[order[at]][4] * 1.3, 16)) + 1
            some = []
            while at < len(order) and asked[order[at]][4] <= reach:
                some.append(order[at])
                at += 1
            low, high = max(0, min(asked[i][0][0] for i in some) - reach), min(n, max(asked[i][0][1] for i in some) + reach + 1)
            for few in self._batches([(asked[i][0], i) for i in some], low, high):
                entries, tails = [], []
                for (f, l), i in few:
                    _, own, score, x, y = asked[i]
                    slope = score * (y**0.5 - x**0.5) / (y - x)
                    flat = score * x**0.5 - slope * x
                    starts, ends = np.arange(low, l + 1), np.arange(f + 1, high)
                    before = sums_before[starts] - sums_before[f] + slope * (starts - f)
                    after = np.where(own[: len(ends)] > 0, own[: len(ends)] - sums_before[ends] + sums_before[f] + self._cost[f] - slope * (ends - f + 1) - flat, LOW)
                    entries.append(np.ceil(before[::-1] if mirrored else after).astype(np.int32))
                    tails.append(after if mirrored else before[::-1])
                sums = self._sweep(np.array([a for a, _ in few]), low, high, not mirrored, entries)
                for (_, i), s, t in zip(few, sums, tails, strict=True):
                    out[i] = s[: len(t)] + t
        return out

    def _block(self, keys: Sequence[int], n: int, mirrored: bool, least: float) -> dict[int, tuple[float, int, int, int]]:
        found: dict[int, tuple[float, int, int, int]] = {}
        self._owns = {k: self._own(k, n) for k in keys}
        size = {k: (n - 1 - k) if mirrored else k + 1 for k in keys}  # places of the short side
        near = NEARBY
        low, high = max(0, keys[0] - near), min(n, keys[-1] + near + 2)
        if max(size.values()) <= FEW:
            self._settle([(k, a) for k in keys for a in range(size[k])], 0, n, mirrored, least, found)
            return found
        self._settle([(k, a) for k in keys for a in range(min(size[k], near))], low, high, mirrored, least, found)
        self._settle([(k, a) for k in keys for a in {size[k] - 1, size[k] // 2}], 0, n, mirrored, least, found)
        score_of = lambda k: found[k][0] if k in found else 0.0
        done = {k: np.zeros(size[k], bool) for k in keys}
        live: dict[int, list[tuple[float, float, float, np.ndarray]]] = {k: [] for k in keys}  # of each key: interval, score and what it leaves above that

        def ask(asked, of) -> None:
            for (pair, _, score, x, y), some, over in zip(asked, of, self._bounds(asked, n, mirrored), strict=True):
                for k in some:
                    held = np.full(size[k], -np.inf)
                    part = over[(k - pair[0]) if mirrored else (pair[1] - k) :][: size[k]]
                    held[: len(part)] = part
                    live[k].append((x, y, score, held))

        def settle(most: int) -> None:
            places, reach = [], 2.0
            for k in list(live):
                score = score_of(k)
                kept = [(x, y, then, over) for x, y, then, over in live[k] if (np.where(done[k], -np.inf, over) - (score - then) * x**0.5).max() >= -SLACK]
                live[k] = kept
                if not kept:
                    del live[k]
                    continue
                top = np.where(done[k], -np.inf, np.max([over - (score - then) * x**0.5 for x, _, then, over in kept], axis=0))
                left = np.flatnonzero(top >= -SLACK)
                some = left[np.argsort(-top[left], kind="stable")[:most]].tolist()
                places += [(k, a) for a in some]
                done[k][some] = True
                reach = max(reach, *(y for _, y, _, _ in kept))
            if places:
                self._settle(places, max(0, keys[0] - int(reach) - 1), min(n, keys[-1] + int(reach) + 2), mirrored, least, found)

        pair = keys[0], keys[-1]
        most = np.zeros(n - 1 - keys[0], np.int64)
        for k in keys:
            most[k - keys[0] :] = np.maximum(most[k - keys[0] :], self._owns[k])
        score = min(map(score_of, keys))
        edges = sorted({min(n + 1, max(i + 2, int(2 * 2 ** (i / 2)))) for i in range(2 * n.bit_length() + 2)})
        ask([(pair, most, score, float(x), float(y)) for x, y in zip(edges[:-1], edges[1:], strict=True)], [keys] * (len(edges) - 1))
        settle(2)
        asked, of = [], []
        for k in live:
            score, x0 = (found[k][0], found[k][2] - found[k][1] + 1) if k in found else (0.0, 2)
            cuts = sorted({2, n + 1, *(max(2, min(n + 1, int(x0 * r) + (r > 1))) for r in CUTS)})
            spans = [(x, y) for x, y, then, over in live[k] if (np.where(done[k], -np.inf, over) - (score - then) * x**0.5).max() >= -SLACK]
            new = [((k, k), self._owns[k], score, float(x), float(y)) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if any(x < v and u < y for u, v in spans)]
            asked += new
            of += [[k]] * len(new)
            live[k] = []
        ask(asked, of)
        while live:
            settle(4)
        return found

    def best(self, key: int, n: int, least: float = 0.0) -> tuple[float, int, int, int] | None:
        """(score, start, end, raw) of the best scope of a key whose end is before n; of equal ones the first end's first start."""
        return self.many([key], n, least).get(key)

    def many(self, keys: Sequence[int], n: int, least: float = 0.0) -> dict[int, tuple[float, int, int, int]]:
        """best of several keys, without those that have none."""
        found = {}
        for level in sorted({int(self.level[k]) for k in keys}):
            self._cost = cost_of(self.level, level)
            self._rise = self._cost[::-1] + np.int32(NEAR)
            self._sums = np.r_[0, self._cost.cumsum(dtype=np.int64)]
            for mirrored in (False, True):
                own = [k for k in sorted(keys) if self.level[k] == level and k + 1 < n and (k + 1 > n - 1 - k) == mirrored]
                i = 0
                while i < len(own):
                    short = min(own[i] + 1, n - 1 - own[i])
                    j = i + 1
                    while j < len(own) and j - i < TOGETHER and own[j] - own[i] <= max(8, short // 8):
                        j += 1
                    found |= self._block(own[i:j], n, mirrored, least)
                    i = j
        return found


class Shorts:
    """Best scopes of keys of short sentences: keys with about as many phrases on both sides are aligned at once, from every place of the
    short side to every one of the other."""

    SIZES = np.array([*range(9), *range(10, 17, 2), *range(20, 33, 4), *range(40, 65, 8), *range(80, 129, 16)])

    def __init__(self, marks: Marks, at: Sequence[int], before: Sequence[int], after: Sequence[int]) -> None:
        """at are the keys' places among all phrases, before and after how many phrases of the sentence lie there; after may not be 0."""
        self.marks, self.at, self.before, self.after = marks, np.array(at, np.intp), np.array(before, np.intp), np.array(after, np.intp)
        n = len(self.at)
        self.root = np.array([k**0.5 for k in range(2 * int(self.SIZES[-1]) + 4)])
        self.top = np.full(n, -np.inf)  # the best score, its start and its end, as their distances from the key
        self.start, self.end = np.zeros(n, np.intp), np.zeros(n, np.intp)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # of a part of the keys: the best score and its start, by end
        self.part, self.column = np.zeros(n, np.intp), np.zeros(n, np.intp)
        a, b = np.minimum(self.before, self.after - 1), np.maximum(self.before, self.after - 1)
        codes = (np.searchsorted(self.SIZES, a) * len(self.SIZES) + np.searchsorted(self.SIZES, b)) * 2 + (self.after - 1 < self.before)
        order = np.argsort(codes, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if n else []:
            code = int(codes[some[0]])
            rows, columns = (int(self.SIZES[x]) for x in divmod(code // 2, len(self.SIZES)))
            step = max(1, 4 * HELD // (rows + 1) ** 2)
            for i in range(0, len(some), step):
                self._align(some[i : i + step], rows, columns, bool(code % 2))

    def _align(self, some: np.ndarray, rows: int, columns: int, mirrored: bool) -> None:
        at, sign, level = self.at[some], -1 if mirrored else 1, self.marks.level
        mine, other = (self.after[some] - 1, self.before[some]) if mirrored else (self.before[some], self.after[some] - 1)
        key_level = level[at]

        def cost(places: np.ndarray) -> np.ndarray:
            here = level[places]
            return np.where(here >= np.maximum(key_level, 0), int(BOUNDARY) * (here - key_level + 1), 0).astype(np.int32) + np.int32(NEAR)

        def gains(d: int, low: int, high: int) -> Iterator[tuple[int, int, np.ndarray]]:
            u = rows - np.arange(low, high)[:, None]  # phrases nearer to the key
            v = d - 1 - rows + u
            ok = (u < mine) & (v < other)
            a, b = np.where(ok, at - sign * (1 + u), at), np.where(ok, at + sign * (1 + v), at)
            yield low, high, np.where(ok, self.marks.pair(a, b) + cost(a if mirrored else b) + np.int32(NEAR), 0).astype(np.int32)[:, None, :]

        first = np.where(np.arange(rows + 1)[:, None] >= rows - np.arange(rows + 1), 0, LOW).astype(np.int32)
        first = np.repeat(first[:, :, None], len(some), axis=2)
        raw = np.empty((columns + 1, rows + 1, len(some)), np.int32)
        for d, now in enumerate(rising(rows, columns, first, gains)):
            if d >= rows:
                raw[d - rows] = now[rows]
        for size, way, own, axis in ((rows, -sign, mine, 1), (columns, sign, other, 0)):
            far = np.arange(size)[:, None]
            spent = np.zeros((size + 1, len(some)), np.int32)
            np.cumsum(np.where(far < own, cost(np.where(far < own, at + way * (1 + far), at)), 0), axis=0, out=spent[1:])
            spent[np.arange(size + 1)[:, None] > own] = -(LOW // 8)
            raw -= np.expand_dims(spent, 1 - axis)
        ends = rows if mirrored else columns
        far = np.arange(ends + 1)[:, None]
        ok = far < self.after[some]
        last = np.where(ok, self.marks.pair(np.broadcast_to(at, ok.shape), np.where(ok, at + 1 + far, at)), 0).astype(np.int32)
        last = np.where(last > 0, last, np.int32(LOW // 8))
        raw += np.expand_dims(last, 0 if mirrored else 1)
        lengths = np.arange(columns + 1)[:, None] + np.arange(rows + 1) + 2
        score = np.where(raw > 0, raw / self.root[lengths][:, :, None], -np.inf)
        if mirrored:
            score = score.transpose(1, 0, 2)
        start = score.shape[1] - 1 - score[:, ::-1].argmax(axis=1)
        score = np.take_along_axis(score, start[:, None], axis=1)[:, 0]
        end = score.argmax(axis=0)
        each = np.arange(len(some))
        self.top[some], self.start[some], self.end[some] = score[end, each], start[end, each], end
        self.part[some], self.column[some] = len(self.parts), each
        self.parts.append((score, start))

    def best(self, j: int, key: int, limit: int | None = None) -> tuple[float, int, int] | None:
        """(score, start, end) of the j-th key, whose place in its sentence is key, as a Grid finds it; its end is before the limit."""
        score, start, end = self.top[j], self.start[j], self.end[j]
        if limit is not None and key + 1 + end >= limit:
            scores, starts = (x[:, self.column[j]] for x in self.parts[self.part[j]])
            if limit <= key + 1:
                return None
            end = scores[: limit - key - 1].argmax()
            score, start = scores[end], starts[end]
        return (float(score), key - int(start), key + 1 + int(end)) if score > -np.inf else None


def scope(items: Sequence[Item], key: int, bonus_start: frozenset[int] = frozenset(), bonus_end: frozenset[int] = frozenset(), least: float = 0.0) -> Scope | None:
    """The best pair of spans [start, key] and [key + 1, end] whose phrases align.

    For each end, phrases before the key are aligned with those after it, from (key, end) outwards: a step takes one
    phrase of each side, or skips one of one side for NEAR and what its boundary costs. The alignment's score is divided
    by the root of the phrases covered; bonuses of 2 are for starts and ends that rules favour. Without bonuses and where affinities are
    integers, the end is found by a Grid.
    """
    grid = None if bonus_start or bonus_end else Grid.of(items)
    if grid is None:
        return align(items, key, range(key + 1, len(items)), bonus_start, bonus_end, least)
    found = grid.best(key, len(items), least)
    return align(items, key, [found[2]], least=least) if found else None


def align(items: Sequence[Item], key: int, ends: Iterable[int], bonus_start: frozenset[int] = frozenset(), bonus_end: frozenset[int] = frozenset(), least: float = 0.0) -> Scope | None:
    """scope among these ends, each aligned by itself."""
    best: Scope | None = None
    for end in ends:
        if affinity(items[key], items[end]) <= 0:
            continue
        rows, columns = key + 1, end - key
        cost_row = [NEAR + boundary(items[key].level, items[i].level) for i in range(key)] + [0.0]
        cost_column = [NEAR + boundary(items[key].level, items[key + 1 + j].level) for j in range(columns)]
        cell = [[float("-inf")] * columns for _ in range(rows)]
        back: list[list[tuple[int, int] | None]] = [[None] * columns for _ in range(rows)]
        for i in range(rows - 1, -1, -1):
            for j in range(columns - 1, -1, -1):
                own = affinity(items[i], items[key + 1 + j])
                if i == key and j == columns - 1:
                    cell[i][j] = own
                    continue
                options = []
                if i + 1 < rows and j + 1 < columns:
                    options.append((cell[i + 1][j + 1] + own - boundary(items[key].level, items[i].level), (i + 1, j + 1)))
                if i + 1 < rows:
                    options.append((cell[i + 1][j] - cost_row[i], (i + 1, j)))
                if j + 1 < columns:
                    options.append((cell[i][j + 1] - cost_column[j], (i, j + 1)))
                if options:
                    cell[i][j], back[i][j] = max(options, key=lambda o: o[0])
        for i in range(rows):
            raw = cell[i][0] / (key - i + 1 + columns) ** 0.5
            score = raw + 2 * (i in bonus_start) + 2 * (end in bonus_end)
            if raw > least and (best is None or score > best.score):
                path, at = [], (i, 0)
                while at is not None:
                    path.append((at[0], key + 1 + at[1]))
                    at = back[at[0]][at[1]]
                best = Scope(i, key, end, score, tuple(path), "strong" if raw >= STRONG else "found")
    return best


#: Relation of an earlier scope (rows: its second span against the later scope's first) and a later one (columns).
RELATIONS = ("apart", "outer", "inner", "same", "bad")


def relation(a: Scope, b: Scope) -> str:
    """How scope a relates to scope b, whose key is later: apart, nested (inner: a lies in a span of b; outer: a span of a
    holds b), same (chained through shared spans), or bad (they cross)."""
    if a.end < b.start:
        return "apart"
    spans_a, spans_b = ((a.start, a.key), (a.key + 1, a.end)), ((b.start, b.key), (b.key + 1, b.end))
    if any(x <= a.start and a.end <= y for x, y in spans_b):
        return "inner"
    if any(x <= b.start and b.end <= y for x, y in spans_a):
        return "outer"
    if a.end == b.key and b.start in (a.start, a.key + 1):
        return "same"
    return "bad"


def consistent(items: Sequence[Item], keys: Sequence[int], retries: int = 3, paths: bool = True) -> list[Scope]:
    """Scopes of all keys; where two cross, the weaker is found again without its end, at most `retries` times, then
    dropped. Without paths they are left empty."""
    grid = Grid.of(items) if keys else None

    def make(k: int, best: tuple[float, int, int, int] | None) -> Scope | None:
        return best and (align(items, k, [best[2]]) if paths else _bare(k, *best[:3]))

    def find(k: int, limit: int) -> Scope | None:
        return scope(items[:limit], k) if grid is None else make(k, grid.best(k, limit))

    if grid is None:
        found = {k: find(k, len(items)) for k in keys}
    else:
        first = grid.many(keys, len(items))
        found = {k: make(k, first.get(k)) for k in keys}
    return _agreed(found, find, retries)


def _bare(key: int, score: float, start: int, end: int) -> Scope:
    return Scope(start, key, end, score, (), "strong" if score >= STRONG else "found")


def _agreed(found: dict[int, Scope | None], find: Callable[[int, int], Scope | None], retries: int) -> list[Scope]:
    """consistent, of the scopes of each key and of how to find the best one of a key with its end before a place."""
    limits: dict[int, int] = {}
    tries = at = 0
    live = [found[k] for k in sorted(found) if found[k]]
    while at < len(live):
        other = _crossed(live, at)
        if other is None:
            at += 1
            continue
        weak = min((live[at], live[other]), key=lambda s: s.score)
        limits[weak.key] = min(limits.get(weak.key, weak.end), weak.end)
        tries += 1
        found[weak.key] = find(weak.key, limits[weak.key]) if tries <= retries else None
        live = [found[k] for k in sorted(found) if found[k]]
        if tries <= retries:  # a new scope may cross any; one that is dropped leaves those before it as they are
            at = 0
    return live


def consistent_many(marks: Marks, sizes: Sequence[int], keys: Sequence[Sequence[int]], retries: int = 3) -> list[tuple[int, Scope]]:
    """consistent without paths of many sentences, whose phrases follow one another: (number of the sentence, scope)."""
    begins = np.r_[0, np.cumsum(sizes)].tolist()
    own = [(i, k) for i, (n, some) in enumerate(zip(sizes, keys, strict=True)) if n <= SHORT for k in some]
    short = Shorts(marks, [begins[i] + k for i, k in own], [k for _, k in own], [sizes[i] - 1 - k for i, k in own])
    place = {one: j for j, one in enumerate(own)}
    out: list[tuple[int, Scope]] = []
    for i, (n, some) in enumerate(zip(sizes, keys, strict=True)):
        if n > SHORT:
            grid = Grid(marks, begins[i], n)
            first = grid.many(some, n)
            find = lambda k, limit, grid=grid: (b := grid.best(k, limit)) and _bare(k, *b[:3])
        else:
            first = {k: b for k in some if (b := short.best(place[i, k], k))}
            find = lambda k, limit, i=i: (b := short.best(place[i, k], k, limit)) and _bare(k, *b)
        found: dict[int, Scope | None] = {k: _bare(k, *b[:3]) for k, b in first.items()}
        out += [(i, s) for s in (_agreed(found, find, retries) if len(found) > 1 else found.values())]
    return out


def _crossed(live: Sequence[Scope], at: int) -> int | None:
    """The first later scope that crosses the one at a place."""
    a, rest = live[at], range(at + 1, len(live))
    if len(rest) > 32:
        start, key, end = np.array([(b.start, b.key, b.end) for b in live[at + 1 :]]).T
        clear = (a.end < start) | ((start <= a.start) & (a.end <= key)) | ((key < a.start) & (a.end <= end)) | ((a.start <= start) & (end <= a.key))
        clear |= ((a.key < start) & (end <= a.end)) | ((a.end == key) & ((start == a.start) | (start == a.key + 1)))
        rest = np.flatnonzero(~clear) + at + 1
        return int(rest[0]) if len(rest) else None
    return next((i for i in rest if relation(a, live[i]) == "bad"), None)


def chains(scopes: Sequence[Scope]) -> list[list[Scope]]:
    """Scopes that go on from each other are one coordination of several members."""
    out: list[list[Scope]] = []
    for s in scopes:
        if out and relation(out[-1][-1], s) == "same":
            out[-1].append(s)
        else:
            out.append([s])
    return out
