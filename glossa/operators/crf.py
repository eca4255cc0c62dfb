"""Linear-chain sequence labelling: feature templates, CRF and MIRA training, decoding."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MACRO = re.compile(r"%x\[(-?\d+),(\d+)\]")


def expand(template: str, rows: Sequence[Sequence[str]], at: int) -> str:
    """The template at a place; places outside read as _B-n and _B+n."""

    def cell(m: re.Match) -> str:
        i, column = at + int(m[1]), int(m[2])
        if i < 0:
            return f"_B{i}"
        return f"_B+{i - len(rows) + 1}" if i >= len(rows) else rows[i][column]

    return MACRO.sub(cell, template)


Place = tuple[np.ndarray, np.ndarray]  # numbers of a place's own features, and of those of its pair with the place before


@dataclass
class Features:
    """Features of unigram templates (U...), for a place's label, and of bigram templates (B..., with macros or none), for the label with
    the one before."""

    templates: tuple[str, ...]
    index: dict[str, int]
    labels: tuple[str, ...]
    pairs: dict[str, int]

    @classmethod
    def build(cls, templates: Sequence[str], data: Sequence[tuple[Sequence[Sequence[str]], Sequence[str]]], least: int = 1) -> Features:
        numbers = []
        for kind in "UB":
            seen = Counter(expand(t, rows, i) for rows, _ in data for i in range(len(rows)) if kind == "U" or i for t in templates if t[:1] == kind)
            numbers.append({f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))})
        return cls(tuple(templates), numbers[0], tuple(sorted({y for _, ys in data for y in ys})), numbers[1])

    def encode(self, rows: Sequence[Sequence[str]]) -> list[Place]:
        def found(kind: str, known: dict[str, int], i: int) -> np.ndarray:
            return np.array([known[f] for t in self.templates if t[:1] == kind and (f := expand(t, rows, i)) in known], int)

        return [(found("U", self.index, i), found("B", self.pairs, i) if i else np.zeros(0, int)) for i in range(len(rows))]

    @property
    def size(self) -> int:
        return len(self.index) * len(self.labels) + len(self.pairs) * len(self.labels) ** 2

    def split(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Views of a weight vector: features by labels, and pair features by labels by labels."""
        n = len(self.labels)
        return w[: len(self.index) * n].reshape(-1, n), w[len(self.index) * n :].reshape(-1, n, n)


def potentials(f: Features, w: np.ndarray, x: list[Place]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of labels by place, and of pairs of labels by place, those of the first unused."""
    own, chain = f.split(w)
    n = len(f.labels)
    return np.array([own[u].sum(axis=0) for u, _ in x]).reshape(-1, n), np.array([chain[b].sum(axis=0) for _, b in x]).reshape(-1, n, n)


def _at(pair: np.ndarray, t: int) -> np.ndarray:
    """The scores of pairs at place t, where they may be the same for all."""
    return pair if pair.ndim == 2 else pair[t]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(unary: np.ndarray, pair: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log partition, marginals of places, marginals of pairs by place), in the log domain."""
    steps, n = unary.shape
    ahead, behind = np.zeros_like(unary), np.zeros_like(unary)
    ahead[0] = unary[0]
    for t in range(1, steps):
        ahead[t] = unary[t] + _lse(ahead[t - 1][:, None] + _at(pair, t), 0)
    for t in range(steps - 2, -1, -1):
        behind[t] = _lse(_at(pair, t + 1) + (unary[t + 1] + behind[t + 1])[None, :], 1)
    z = float(_lse(ahead[-1], 0))
    joint = np.zeros((steps, n, n))
    for t in range(1, steps):
        joint[t] = np.exp(ahead[t - 1][:, None] + _at(pair, t) + (unary[t] + behind[t])[None, :] - z)
    return z, np.exp(ahead + behind - z), joint


def viterbi(unary: np.ndarray, pair: np.ndarray) -> list[int]:
    """The best labels; ties keep the first label."""
    best, back = unary[0], []
    for t in range(1, len(unary)):
        scores = best[:, None] + _at(pair, t)
        back.append(scores.argmax(axis=0))
        best = scores.max(axis=0) + unary[t]
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def viterbi_many(unary: np.ndarray, pair: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """viterbi of many sequences at once, as their labels end to end: unary holds their places end to end, pair is one matrix for all
    places or one for each. Sequences go side by side, so a step of all costs little more than a step of one."""
    sizes = np.asarray(sizes, int)
    begins = np.r_[0, sizes.cumsum()[:-1]] if len(sizes) else np.zeros(0, int)
    order = np.argsort(-sizes, kind="stable")
    sizes, begins = sizes[order], begins[order]
    live = int((sizes > 0).sum())
    sizes, begins = sizes[:live], begins[:live]
    out = np.zeros(len(unary), int)
    if not live:
        return out
    kind = np.int8 if unary.shape[1] < 128 else int
    back = np.zeros(unary.shape, kind)
    best = unary[begins].copy()
    into = np.ascontiguousarray(pair.T) if pair.ndim == 2 else None  # by label, then by the label before
    longer = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # how many have at least t places, by t - 1
    for t in range(1, int(sizes[0])):
        n = longer[t]
        at = begins[:n] + t
        scores = best[:n, None, :] + (into[None] if into is not None else pair[at].transpose(0, 2, 1))
        back[at] = came = scores.argmax(axis=2)
        best[:n] = np.take_along_axis(scores, came[:, :, None], 2)[:, :, 0] + unary[at]
    label = best.argmax(axis=1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        n = longer[t]
        at = begins[:n] + t
        out[at] = label[:n]
        if t:
            label[:n] = back[at, label[:n]]
    return out


def n_best(unary: np.ndarray, pair: np.ndarray, k: int) -> list[tuple[float, list[int]]]:
    """The k best label sequences, by the k best at each place and label."""
    n = unary.shape[1]
    states = [[(float(unary[0, y]), (y,))] for y in range(n)]
    for t in range(1, len(unary)):
        own = _at(pair, t)
        states = [sorted(((s + float(own[p, y] + unary[t, y]), (*seq, y)) for p in range(n) for s, seq in states[p]), key=lambda x: (-x[0], x[1]))[:k] for y in range(n)]
    return [(s, list(seq)) for s, seq in sorted((x for own in states for x in own), key=lambda x: (-x[0], x[1]))[:k]]


def gradient(f: Features, w: np.ndarray, x: list[Place], y: Sequence[int]) -> tuple[float, np.ndarray]:
    """Negative log likelihood and its gradient."""
    unary, pair = potentials(f, w, x)
    z, single, joint = marginals(unary, pair)
    g = -_counts(f, x, y)
    own, chain = f.split(g)
    for t, (u, b) in enumerate(x):
        np.add.at(own, u, single[t])
        np.add.at(chain, b, joint[t])
    score = sum(unary[t, y[t]] for t in range(len(x))) + sum(pair[t, y[t - 1], y[t]] for t in range(1, len(x)))
    return z - score, g


Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def lbfgs(objective: Objective, size: int, l1: float = 0.0, rounds: int = 60, memory: int = 6, tolerance: float = 1e-5) -> np.ndarray:
    """L-BFGS with backtracking; with l1 the orthant-wise form: steps stay in the orthant of the pseudo-gradient."""
    w = np.zeros(size)
    past: list[tuple[np.ndarray, np.ndarray]] = []

    def pseudo(w: np.ndarray, g: np.ndarray) -> np.ndarray:
        if not l1:
            return g
        return np.where(w > 0, g + l1, np.where(w < 0, g - l1, np.where(g + l1 < 0, g + l1, np.where(g - l1 > 0, g - l1, 0.0))))

    value, g = objective(w)
    value += l1 * np.abs(w).sum()
    for _ in range(rounds):
        p = pseudo(w, g)
        if np.abs(p).max(initial=0.0) < tolerance:
            break
        d, stack = -p, []
        for s, y in reversed(past):
            a = s @ d / (s @ y)
            stack.append(a)
            d = d - a * y
        if past:
            d = d * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(stack), strict=True):
            d = d + (a - y @ d / (s @ y)) * s
        if l1:
            d = np.where(d * p < 0, d, 0.0)
        step = 1.0 if past else 1.0 / max(1.0, float(np.linalg.norm(p)))
        orthant = np.where(w != 0, np.sign(w), -np.sign(p))
        for _ in range(30):
            new = w + step * d
            if l1:
                new = np.where(new * orthant > 0, new, 0.0)
            new_value, new_g = objective(new)
            new_value += l1 * np.abs(new).sum()
            if new_value <= value + 1e-4 * (p @ (new - w)):
                break
            step /= 2
        else:
            break
        s, y = new - w, new_g - g
        if s @ y > 1e-10:
            past = [*past, (s, y)][-memory:]
        done = value - new_value < tolerance * max(1.0, abs(value))
        w, g, value = new, new_g, new_value
        if done:
            break
    return w


def train(f: Features, data: Sequence[tuple[Sequence[Sequence[str]], Sequence[str]]], method: str = "l2", c: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights by CRF with an l2 or l1 penalty, or by MIRA (margin updates, averaged)."""
    at = {y: i for i, y in enumerate(f.labels)}
    coded = [(f.encode(rows), [at[y] for y in ys]) for rows, ys in data if len(rows)]
    if method == "mira":
        return _mira(f, coded, c, rounds)

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, g = 0.0, np.zeros(f.size)
        for x, y in coded:
            v, own = gradient(f, w, x, y)
            value, g = value + v, g + own
        return (value + w @ w / (2 * c), g + w / c) if method == "l2" else (value, g)

    return lbfgs(objective, f.size, 0.0 if method == "l2" else 1 / c, rounds)


def _counts(f: Features, x: list[Place], y: Sequence[int]) -> np.ndarray:
    out = np.zeros(f.size)
    own, chain = f.split(out)
    for t, (u, b) in enumerate(x):
        np.add.at(own, (u, y[t]), 1.0)
        if t:
            np.add.at(chain, (b, y[t - 1], y[t]), 1.0)
    return out


def _mira(f: Features, coded: list, c: float, rounds: int) -> np.ndarray:
    w, total, n = np.zeros(f.size), np.zeros(f.size), 0
    for _ in range(rounds):
        wrong = 0
        for x, y in coded:
            guess = viterbi(*potentials(f, w, x))
            loss = sum(a != b for a, b in zip(guess, y, strict=True))
            if loss:
                wrong += 1
                d = _counts(f, x, y) - _counts(f, x, guess)
                w = w + min(c, max(0.0, (loss - w @ d) / max(d @ d, 1e-9))) * d
            total, n = total + w, n + 1
        if not wrong:
            break
    return total / max(n, 1)


def distributed_objective(rows: DataFrame, f: Features, c: float) -> Objective:
    """The l2 objective over rows (tokens array<string>, tags array<string>): one pass of the executors each, with one
    partial sum per partition and a tree of sums, so that the driver gets a few vectors."""
    at = {y: i for i, y in enumerate(f.labels)}

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        held = rows.sparkSession.sparkContext.broadcast(w)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            value, g = 0.0, np.zeros(f.size)
            for pdf in frames:
                for tokens, tags in zip(pdf["tokens"], pdf["tags"], strict=True):
                    if len(tokens):
                        v, own = gradient(f, held.value, f.encode(columns(tokens)), [at[y] for y in tags])
                        value, g = value + v, g + own
            at_ = np.flatnonzero(g)
            yield pd.DataFrame({"i": [-1, *at_.tolist()], "v": [value, *g[at_].tolist()]})

        sums = rows.mapInPandas(run, "i long, v double").groupBy("i").sum("v").toPandas()
        held.unpersist()
        g = np.zeros(f.size)
        own = sums[sums["i"] >= 0]
        g[own["i"].to_numpy()] = own["sum(v)"].to_numpy()
        value = float(sums.loc[sums["i"] < 0, "sum(v)"].sum())
        return value + w @ w / (2 * c), g + w / c

    return objective


#: Named entities: each kind at the head, in the middle, at the tail or single, and other.
KINDS = ("ORGANIZATION", "PERSON", "LOCATION", "ARTIFACT", "DATE", "TIME", "MONEY", "PERCENT")
PLACES = ("head", "middle", "tail", "single")
ENTITY_LABELS = tuple(f"{k}:{p}" for k in KINDS for p in PLACES) + ("OTHER",)


def may_follow(before: str | None, label: str | None) -> bool:
    """Whether an entity label may follow another; None stands for the sentence's ends."""
    kind_a, _, place_a = (before or "OTHER").partition(":")
    kind_b, _, place_b = (label or "OTHER").partition(":")
    if place_a in ("head", "middle"):
        return kind_a == kind_b and place_b in ("middle", "tail")
    return place_b not in ("middle", "tail")


def decode_entities(probabilities: np.ndarray, barred: Sequence[bool] | None = None) -> list[str]:
    """The most probable legal labels from marginals (places x 33); `barred` places can't be head or single."""
    return decode_entities_many(probabilities, [len(probabilities)], barred) if len(probabilities) else []


LEGAL = np.array([[0.0 if may_follow(a, b) else -1e9 for b in ENTITY_LABELS] for a in ENTITY_LABELS])
LEGAL_FIRST = np.array([0.0 if may_follow(None, b) else -1e9 for b in ENTITY_LABELS])
LEGAL_LAST = np.array([0.0 if may_follow(a, None) else -1e9 for a in ENTITY_LABELS])
STARTS = np.array([p.endswith((":head", ":single")) for p in ENTITY_LABELS])


def decode_entities_many(probabilities: np.ndarray, sizes: Sequence[int], barred: Sequence[bool] | None = None) -> list[str]:
    """decode_entities of many sentences, whose places stand end to end in probabilities and barred, as they do in the labels."""
    unary = np.log(np.maximum(probabilities, 1e-300))
    for t, no in enumerate(barred if barred is not None else ()):
        if no:
            unary[t, STARTS] = -1e9
    sizes = np.asarray(sizes, int)
    ends = sizes.cumsum()[sizes > 0]
    unary[ends - sizes[sizes > 0]] += LEGAL_FIRST
    unary[ends - 1] += LEGAL_LAST
    return [ENTITY_LABELS[i] for i in viterbi_many(unary, LEGAL, sizes).tolist()]


def columns(tokens: Sequence) -> list[Sequence[str]]:
    """The rows of a sentence: tokens are texts, or arrays of columns."""
    return [[t] if isinstance(t, str) else list(t) for t in tokens]


def tag(rows: DataFrame, key: Sequence[str], f: Features, w: np.ndarray) -> DataFrame:
    """rows (key, tokens array<string>, or array<array<string>> for several columns) to (key, tags array<string>)."""
    held = rows.sparkSession.sparkContext.broadcast((f, w))

    @F.arrow_udf("array<string>")
    def run(sentences):
        import pyarrow as pa

        f, w = held.value
        tables = Scores(f, w)
        sizes = np.array(sentences.value_lengths().fill_null(0))
        ends = np.r_[0, sizes.cumsum()]
        flat, tags, row = sentences.flatten(), [], 0
        names = pa.array(f.labels, pa.string())
        while row < len(sizes):  # as many sentences as have HELD places, one at least
            last = max(row + 1, int(np.searchsorted(ends, ends[row] + HELD, "right")) - 1)
            own = columns(flat.slice(ends[row], ends[last] - ends[row]).to_pylist())
            labels = viterbi_many(*tables.potentials(own, sizes[row:last]), sizes[row:last])
            tags.append(names.take(pa.array(labels)))
            row = last
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.concat_arrays(tags) if tags else pa.array([], pa.string()))

    return rows.select(*key, run("tokens").alias("tags"))


#: How many places a task scores at a time, beside those of a longer sentence.
HELD = 20_000


class Scores:
    """The potentials of many sentences at once. A template's features are looked up by template and cell text; a template of one
    cell keeps what it found for a text."""

    def __init__(self, f: Features, w: np.ndarray) -> None:
        self.f = f
        own, chain = f.split(w)
        self.own, self.chain = np.r_[own, np.zeros((1, own.shape[1]))], np.r_[chain, np.zeros((1, *chain.shape[1:]))]  # the last for none
        self.known: list[dict[str, int]] = [{} for _ in f.templates]

    def _numbers(self, k: int, rows: Sequence[Sequence[str]], sizes: Sequence[int], known: dict[str, int]) -> np.ndarray:
        template, missing = self.f.templates[k], len(known)
        cells = MACRO.findall(template)
        begins = np.r_[0, np.asarray(sizes, int).cumsum()]
        if not cells:
            return np.full(len(rows), known.get(template, missing))
        if cells == [("0", c := cells[0][1])]:
            at, held = int(c), self.known[k]
            if len(held) > 1 << 18:
                held.clear()
            before, after = template[: template.index("%")], template[template.index("]") + 1 :]
            out = np.empty(len(rows), int)
            for i, r in enumerate(rows):
                n = held.get(r[at])
                if n is None:
                    n = held[r[at]] = known.get(before + r[at] + after, missing)
                out[i] = n
            return out
        return np.array([known.get(expand(template, rows[a:b], i), missing) for a, b in zip(begins[:-1], begins[1:], strict=True) for i in range(b - a)], int)

    def potentials(self, rows: Sequence[Sequence[str]], sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """potentials of sentences end to end; one matrix of pairs for all places where no bigram template reads a cell."""
        f, n = self.f, len(self.f.labels)
        apart = any(t[:1] == "B" and "%x" in t for t in f.templates)
        unary, pair, shared = np.zeros((len(rows), n)), np.zeros((len(rows) if apart else 0, n, n)), np.zeros((n, n))
        for k, t in enumerate(f.templates):
            if t[:1] == "U":
                unary += self.own[self._numbers(k, rows, sizes, f.index)]
            elif t[:1] == "B" and apart:
                pair += self.chain[self._numbers(k, rows, sizes, f.pairs)]
            elif t[:1] == "B":
                shared += self.chain[f.pairs.get(t, len(f.pairs))]
        return unary, pair if apart else shared
