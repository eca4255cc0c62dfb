"""Dependency trees of a sentence: a chart parser with barriers and a beam, and the exhaustive search it is tested on.

Phrases are numbered left to right and depend to the right. A head assignment is a tree that doesn't cross.
"""

from __future__ import annotations

import heapq
import itertools
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

RELAXED = 1000.0


@dataclass(frozen=True)
class Phrase:
    """preference: which nearest governor is the default, -1 for the farthest. barrier: which later phrases end the
    search; None for the first governor with any link. slots: open slots as a governor. case: surface case as a dependent."""

    preference: int = 1
    barrier: frozenset[int] | None = frozenset()
    topic: bool = False
    comma: bool = False
    predicate: bool = False
    topic_bonus: float = 0.0
    case: str | None = None
    slots: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Sentence:
    """types[i][j] is the dependency type of i on j > i, or None; coordinated pairs have type P already."""

    phrases: tuple[Phrase, ...]
    types: tuple[tuple[str | None, ...], ...]

    def governors(self, i: int) -> list[int]:
        return [j for j in range(i + 1, len(self.phrases)) if self.types[i][j]]

    def default(self, i: int) -> int:
        """Rank, from 0, of the default governor of i among its governors."""
        n = len(self.governors(i))
        p = self.phrases[i].preference
        return max(0, n - 1 if p == -1 else min(p, n) - 1)


def link_score(s: Sentence, i: int, j: int) -> float:
    """What the link i -> j scores by itself: distance from the default position, a comma before its neighbour, and
    relaxation."""
    governors = s.governors(i)
    if j not in governors:
        return -RELAXED
    off = abs(s.default(i) - governors.index(j))
    score = -off * (1.0 if s.phrases[i].topic else 2.0)
    if s.phrases[i].comma and j == i + 1 and s.default(i) != 0:
        score -= 5
    return score


def governor_score(s: Sentence, j: int, dependents: Sequence[int]) -> float:
    """What a predicate scores with its dependents: the first topic, slots that they fill once, and slots that are left
    for dependents without a case."""
    g = s.phrases[j]
    if not g.predicate:
        return 0.0
    score, filled, bare = 0.0, set(), 0
    if any(s.phrases[i].topic for i in dependents):
        score += 10 + g.topic_bonus
    for i in dependents:
        case = s.phrases[i].case
        if case is None:
            bare += not s.phrases[i].topic
        elif case in g.slots and case not in filled:
            filled.add(case)
            score += 10
    return score + 10 * min(len(g.slots - filled), bare)


def tree_score(s: Sentence, heads: Sequence[int]) -> float:
    n = len(s.phrases)
    links = sum(link_score(s, i, heads[i]) for i in range(n - 1))
    return links + sum(governor_score(s, j, [i for i in range(n - 1) if heads[i] == j]) for j in range(n))


@dataclass(order=True)
class Cell:
    """A span with its right end as root. links is the sum of link scores, done that of governors below the root."""

    total: float
    heads: tuple[int, ...] = field(compare=False)
    links: float = field(compare=False)
    done: float = field(compare=False)


def parse(s: Sentence, beam: int = 64, nbest: int = 1, seconds: float | None = None) -> list[tuple[float, tuple[int, ...]]]:
    """The best (score, heads), heads of the last phrase being -1. A span [i, j] joins a left span, rooted at its right
    end k, below the root j; a barrier phrase between k and j that k could have linked to ends k's reach.

    Where nothing spans the sentence, or time runs out, every phrase depends on its right neighbour.
    """
    return search(s, beam, nbest, seconds)[0]


def search(s: Sentence, beam: int = 64, nbest: int = 1, seconds: float | None = None) -> tuple[list[tuple[float, tuple[int, ...]]], str | None]:
    """parse, and why it fell back to the right neighbours: time, or none where nothing spans the sentence; else null."""
    n = len(s.phrases)
    if not n:
        return [], None
    stop = time.monotonic() + seconds if seconds else None
    reach = [_reach(s, i) for i in range(n)]
    chart: dict[tuple[int, int], list[Cell]] = {(i, i): [Cell(0.0, (-1,), 0.0, 0.0)] for i in range(n)}
    for j in range(n):
        for i in range(j - 1, -1, -1):
            if stop and time.monotonic() > stop:
                return [fallback(s)], "time"
            found: dict[tuple[int, ...], Cell] = {}
            for k in range(i, j):
                left, right = chart.get((i, k), ()), chart.get((k + 1, j), ())
                if not left or not right or not (s.types[k][j] or not reach[k]) or (reach[k] and j > reach[k]):
                    continue
                own = link_score(s, k, j)
                for a, b in itertools.product(left, right):
                    heads = (*a.heads[:-1], j - i, *(h + k + 1 - i if h >= 0 else -1 for h in b.heads))
                    done = a.done + governor_score(s, k, [i + x for x, h in enumerate(heads[: k - i]) if h == k - i]) + b.done
                    links = a.links + b.links + own
                    root = governor_score(s, j, [i + x for x, h in enumerate(heads) if h == j - i])
                    found[heads] = Cell(links + done + root, heads, links, done)
            if found:
                chart[i, j] = heapq.nsmallest(beam, found.values(), key=lambda c: (-c.total, c.heads))
    top = chart.get((0, n - 1))
    return ([(c.total, c.heads) for c in top[:nbest]], None) if top else ([fallback(s)], "none")


def _reach(s: Sentence, i: int) -> int:
    """The farthest phrase that i may depend on; 0 where it has no governor and is relaxed."""
    governors = s.governors(i)
    if not governors:
        return 0
    p = s.phrases[i]
    if p.barrier is None:
        return governors[0] if p.preference != -1 else governors[-1]
    return next((j for j in governors if j in p.barrier), governors[-1])


def fallback(s: Sentence) -> tuple[float, tuple[int, ...]]:
    n = len(s.phrases)
    heads = (*range(1, n), -1)
    return tree_score(s, heads), heads


def exhaustive(s: Sentence) -> tuple[float, tuple[int, ...]]:
    """The best of all trees that don't cross, by enumeration from the right; for short sentences and tests."""
    n = len(s.phrases)
    reach = [_reach(s, i) for i in range(n)]
    best: tuple[float, tuple[int, ...]] | None = None

    def place(i: int, heads: list[int]) -> None:
        nonlocal best
        if i < 0:
            score = tree_score(s, heads)
            if best is None or (-score, tuple(heads)) < (-best[0], best[1]):
                best = score, tuple(heads)
            return
        j = i + 1
        while j > 0 and j < n:  # the phrases that a link from i may reach without crossing are its neighbour and that one's heads
            if (s.types[i][j] and j <= reach[i]) or not reach[i]:
                heads[i] = j
                place(i - 1, heads)
            j = heads[j]

    place(n - 2, [-1] * n)
    return best if best else fallback(s)


def draw(labels: Sequence[str], heads: Sequence[int]) -> str:
    """The tree as text, one phrase a line, lines joined by box characters."""
    n = len(labels)
    depth = [0] * n
    for i in range(n - 2, -1, -1):
        depth[i] = depth[heads[i]] + 1
    grid = [[" "] * (2 * max(depth, default=0) + 1) for _ in range(n)]
    for i in range(n - 1):
        column = 2 * (max(depth) - depth[i])
        grid[i][column] = "┐" if grid[i][column] == " " else "┤"
        for r in range(i + 1, heads[i]):
            grid[r][column] = "│" if grid[r][column] == " " else ("┤" if grid[r][column] == "┐" else grid[r][column])
        grid[heads[i]][column] = "└" if grid[heads[i]][column] == " " else grid[heads[i]][column]
    width = max((len(x) for x in labels), default=0)
    return "\n".join((label.rjust(width) + "─" + "".join(row)).rstrip() for label, row in zip(labels, grid, strict=True))


def to_sexp(labels: Sequence[str], heads: Sequence[int]) -> str:
    """(label child child ...), quoted where needed."""
    quote = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"' if any(c in x for c in ' ()"\\') or not x else x

    def one(i: int) -> str:
        below = [one(k) for k in range(len(heads)) if heads[k] == i]
        return "(" + " ".join([quote(labels[i]), *below]) + ")"

    return one(len(heads) - 1) if heads else "()"


def plain_sentence(cases: Sequence, commas: Sequence, predicates: Sequence) -> Sentence:
    """A row of parse_sentences as a sentence for search, which search_plain is tested on."""
    n = len(cases)
    own = tuple(
        Phrase(1, frozenset(j for j in range(n) if commas[j] and predicates[j]), cases[i] == "topic", bool(commas[i]), bool(predicates[i]), 1.0, None if cases[i] in (None, "topic") else cases[i], frozenset(("subject", "object")) if predicates[i] else frozenset())
        for i in range(n)
    )
    return Sentence(own, tuple(tuple("D" if j > i and (predicates[j] or j == n - 1) else None for j in range(n)) for i in range(n)))


#: What a phrase is to its governor in parse_sentences: no case, a slot's case, the topic, another case.
BARE, SUBJECT, OBJECT, TOPIC, OTHER = range(5)


def _tables() -> tuple[list[int], list[list[int]]]:
    """What a predicate scores by its dependents' state, and the state after one more of a kind. A state has a bit for a
    subject, an object and a topic, and counts up to two without a case."""
    states = range(24)
    score = [11 * (s >> 2 & 1) + 10 * min(2, (s & 1) + (s >> 1 & 1) + (s >> 3)) for s in states]
    after = [[s if s >> 3 == 2 else s + 8, s | 1, s | 2, s | 4, s] for s in states]
    return score, after


_SCORE, _AFTER = _tables()
KEPT = 1 << 16  # answers for short sentences that are kept for equal ones
SHORT = 20


def search_plain(kinds: Sequence[int], predicates: Sequence[bool], barriers: Sequence[bool], beam: int = 8, seconds: float | None = None) -> tuple[float, list[int], str | None]:
    """search's best for sentences as parse_sentences builds them: (score, heads, why it fell back).

    The same chart with the same beam, but only cells that the whole sentence can use: those that begin at phrase 0 and
    those without a barrier before their end, and of their splits only those after a predicate or after the first phrase.
    All scores are integers, so a cell's order is that of its parts: of the pairs of two ordered lists only those whose ranks
    multiply to the beam at most can be among the best. An item is (-total, heads as code points, what it scores
    without its root, state of the root).
    """
    n = len(kinds)
    if n < 2:
        return 0.0, [-1] * n, None
    stop = time.monotonic() + seconds if seconds else None
    after = [0] * (n + 1)  # predicates before each phrase
    for i in range(n):
        after[i + 1] = after[i] + bool(predicates[i])
    ends = [n - 1] * n  # the first barrier from each phrase on
    for i in range(n - 2, -1, -1):
        ends[i] = i if barriers[i] else ends[i + 1]
    governors = [j for j in range(n) if predicates[j] or j == n - 1]
    ahead = len(governors)  # governors[ahead:] lie after i
    leaf = [(0, "", 0, 0)]
    sides: dict[int, dict[int, list]] = {}  # of a predicate k: the right spans that it may join, with its link, by their root
    row: dict[int, list] = {}
    cells: dict[int, list] = {}
    for i in range(n - 1, -1, -1):
        side: dict[int, list] = {}
        for j, right in row.items():
            if not (predicates[j] or j == n - 1):
                continue
            own = (1 if kinds[i] == TOPIC else 2) * (after[j] - after[i + 1])
            head, kind = chr(j), kinds[i]
            if predicates[j]:
                made = [(-(b[2] - own + _SCORE[t]), head + b[1], b[2] - own, t) for b in right for t in (_AFTER[b[3]][kind],)]
                made.sort()
            else:
                made = [(b[0] + own, head + b[1], b[2] - own, 0) for b in right]
            side[j] = made
        if predicates[i]:
            sides[i] = side
        cells = {i: leaf}
        last = ends[i] if i else n - 1
        for at in range(ahead, len(governors)):
            j = governors[at]
            if j > last:
                break
            if stop and time.monotonic() > stop:
                return _chain(kinds, predicates)
            # nearest first: far splits cost more and are soon beyond the limit
            splits = [(cells[k], sides[k][j]) for k in reversed(governors[ahead:at]) if j in sides[k]]
            if not splits:
                cells[j] = side[j]  # the first phrase is a leaf: the order is that of the right span
                continue
            best = list(side.get(j, ()))
            limit = best[beam - 1][0] if len(best) >= beam else None
            for left, right in splits:
                first = right[0][0]
                found = []
                for rank, a in enumerate(left, 1):
                    own = a[0]
                    if limit is not None and own + first > limit:
                        break
                    for b in right[: beam // rank]:
                        total = own + b[0]
                        if limit is not None and total > limit:
                            break
                        found.append((total, a[1] + b[1], b[2] - own, b[3]))
                if found:
                    best += found
                    best.sort()
                    del best[beam:]
                    if len(best) == beam:
                        limit = best[-1][0]
            cells[j] = best
        row = cells
        if governors[ahead - 1] == i:
            ahead -= 1
    total, heads, _, _ = cells[n - 1][0]
    return float(-total), [*map(ord, heads), -1], None


def _chain(kinds: Sequence[int], predicates: Sequence[bool]) -> tuple[float, list[int], str]:
    """Every phrase on its right neighbour, for a sentence out of time. A neighbour that is no predicate, nor the last, is no governor."""
    n = len(kinds)
    score = -RELAXED * sum(not predicates[j] for j in range(1, n - 1)) + sum(_SCORE[_AFTER[0][kinds[j - 1]]] for j in range(1, n) if predicates[j])
    return score, [*range(1, n), -1], "time"


def parse_sentences(phrases: DataFrame, key: Sequence[str], beam: int = 8, seconds: float = 30.0) -> DataFrame:
    """phrases grouped in rows (key, cases array<string>, commas array<boolean>, predicates array<boolean>) to (key, heads,
    score, fallback: why the heads are the right neighbours, see search). A phrase may depend on any later predicate, up to the first with a comma; the last phrase is the root."""
    kind = {None: BARE, "subject": SUBJECT, "object": OBJECT, "topic": TOPIC}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[bytes, tuple] = {}

        def one(cases: Sequence, commas: Sequence, predicates: Sequence) -> tuple[float, list[int], str | None]:
            kinds, ps = [kind.get(c, OTHER) for c in cases], [bool(p) for p in predicates]
            barriers = [bool(c) and p for c, p in zip(commas, ps, strict=True)]
            if len(kinds) > SHORT:
                return search_plain(kinds, ps, barriers, beam, seconds)
            like = bytes(4 * k + 2 * p + b for k, p, b in zip(kinds, ps, barriers, strict=True))
            found = kept.get(like)
            if found is None:
                found = search_plain(kinds, ps, barriers, beam, seconds)
                if found[2] is None and len(kept) < KEPT:
                    kept[like] = found
            return found

        for pdf in frames:
            found = [one(c.tolist(), m.tolist(), p.tolist()) for c, m, p in zip(pdf["cases"], pdf["commas"], pdf["predicates"], strict=True)]
            yield pdf[list(key)].assign(heads=[h for _, h, _ in found], score=[x for x, _, _ in found], fallback=[why for _, _, why in found])

    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

    schema = StructType([phrases.schema[k] for k in key]).add("heads", ArrayType(IntegerType())).add("score", DoubleType()).add("fallback", StringType())
    return phrases.select(*key, "cases", "commas", "predicates").mapInPandas(run, schema)
