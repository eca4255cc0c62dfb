"""Conversions between trees of phrases, basic phrases and morphemes, and frames of a whole tree."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from glossa.operators.frames import Element, Frame, best_frames


def finer_heads(heads: Sequence[int], spans: Sequence[tuple[int, int]], anchors: Sequence[int] | None = None) -> list[int]:
    """Heads of finer units from those of coarser ones: spans[i] is the range of units of coarse unit i. Units of a span
    chain to the right; its last one depends on the anchor (the first unit, where none is given) of the head's span."""
    out: list[int] = []
    for i, (first, last) in enumerate(spans):
        out += range(first + 1, last + 1)
        out.append(-1 if heads[i] < 0 else (anchors[heads[i]] if anchors else spans[heads[i]][0]))
    return out


def coarser_heads(heads: Sequence[int], spans: Sequence[tuple[int, int]]) -> list[int]:
    """Heads of coarser units: where the first link that leaves each span goes."""
    of = {u: i for i, (first, last) in enumerate(spans) for u in range(first, last + 1)}
    out = []
    for i, (first, last) in enumerate(spans):
        leaving = [heads[u] for u in range(last, first - 1, -1) if heads[u] < 0 or of[heads[u]] != i]
        out.append(-1 if not leaving or leaving[0] < 0 else of[leaving[0]])
    return out


def expand_coordination(heads: Sequence[int], types: Sequence[str]) -> list[int]:
    """Heads with coordination resolved: a member (type P) takes the head of the last member of its chain."""
    out = list(heads)
    for i in range(len(heads)):
        j = i
        while types[j] == "P" and heads[j] >= 0:
            j = heads[j]
        out[i] = heads[j] if types[i] == "P" else heads[i]
    return out


def depths(heads: Sequence[int]) -> list[int]:
    """Links from each unit to the root; heads are to the right."""
    out = [0] * len(heads)
    for i in range(len(heads) - 1, -1, -1):
        out[i] = out[heads[i]] + 1 if heads[i] >= 0 else 0
    return out


def merge_nodes(heads: Sequence[int], joined: Sequence[bool]) -> tuple[list[int], list[tuple[int, int]]]:
    """(heads, spans) after each unit with joined[i] is merged into the next one; finer_heads with the spans undoes it."""
    spans: list[tuple[int, int]] = []
    first = 0
    for i in range(len(heads)):
        if not joined[i] or i == len(heads) - 1:
            spans.append((first, i))
            first = i + 1
    return coarser_heads(heads, spans), spans


@dataclass(frozen=True)
class TreeUnit:
    """A unit of a tree: its word, the cases it may fill at its head, and its frames where it is a predicate."""

    word: str
    cases: tuple[str, ...] = ()
    adjacent: bool = False
    frames: tuple[Frame, ...] = ()


def analyse_tree(units: Sequence[TreeUnit], heads: Sequence[int], k: int = 5, relative: Callable[[TreeUnit], tuple[str, ...]] | None = None) -> tuple[float, dict[int, tuple[str, dict[str, str]]]]:
    """The sum of the best frames' scores and, for each predicate, its frame and what fills its slots.

    Dependents give their cases; the head of a predicate in a relative clause is one more element, with the cases that
    `relative` allows it.
    """
    total, out = 0.0, {}
    for j, u in enumerate(units):
        if not u.frames:
            continue
        below = [units[i] for i in range(len(units)) if heads[i] == j and units[i].cases]
        elements = [Element(x.word, x.cases, x.adjacent) for x in below]
        if relative and heads[j] >= 0 and not units[heads[j]].frames:
            elements.append(Element(units[heads[j]].word, relative(units[heads[j]])))
        best = best_frames(tuple(elements), list(u.frames), k)
        score, frame_id, slots = best[0]
        frame = next(f for f in u.frames if f.frame_id == frame_id)
        total += score
        out[j] = (frame_id, {frame.slots[s].case: e.word for e, s in zip(elements, slots, strict=True) if s >= 0})
    return total, out
