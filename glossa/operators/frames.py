"""Case frames: ranking, slot scores and the assignment of elements to slots."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNASSIGNED, UNMATCHED_ADJACENT = -20.0, -500.0
LOG_ZERO, LOG_UNKNOWN = math.log(1e-6), math.log(1e-5)


def top_k(rows: DataFrame, partition: list[str], order: list[Column], k: int) -> DataFrame:
    """The k best rows of each partition with `rank`; Spark limits groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def lookup_frames(predicates: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of each predicate: by nearest element, predicate and voice; else by predicate and voice; else by predicate;
    else the default frame, that of predicate `*`."""
    voiced = lambda a, b: (F.col(a) == F.col("f_predicate")) & (F.col(b) == F.col("f_voice"))
    f = frames.select(*[F.col(c).alias(f"f_{c}") for c in frames.columns])
    keyed = predicates.withColumn("_near", F.concat_ws(":", "nearest", "predicate"))
    out, rest = None, keyed
    for at in (voiced("_near", "voice"), voiced("predicate", "voice"), F.col("predicate") == F.col("f_predicate"), F.col("f_predicate") == "*"):
        found = rest.join(f, at)
        out = found if out is None else out.unionByName(found)
        rest = rest.join(f, at, "left_anti")
    return out.drop("_near")


def slot_similarity(exact: Column, by_code: Column, agent: Column, kind: Column) -> Column:
    """How well an element fits a slot, 0 to 11: an example, else the better of thesaurus, agent and kind matches."""
    return F.when(exact, 11.0).otherwise(F.greatest(F.coalesce(by_code, F.lit(0.0)) * 11, F.when(agent, 8.0).otherwise(0.0), F.when(kind, 10.0).otherwise(0.0)))


@dataclass(frozen=True)
class Slot:
    case: str
    examples: dict[str, float] = field(default_factory=dict)
    filled: float = 0.5
    obligatory: bool = False
    adjacent: bool = False


@dataclass(frozen=True)
class Frame:
    frame_id: str
    probability: float
    slots: tuple[Slot, ...]


@dataclass(frozen=True)
class Element:
    word: str
    cases: tuple[str, ...]
    adjacent: bool = False


def slot_log(element: Element, slot: Slot) -> float:
    """Log of P(filled) * P(word | slot), with floors; an example wins over the general class *."""
    p = slot.examples.get(element.word, slot.examples.get("*", 0.0))
    total = sum(slot.examples.values())
    log_word = math.log(p / total) if p and total else LOG_ZERO
    return log_word + (math.log(slot.filled) if slot.filled > 0 else LOG_ZERO)


def assign(elements: tuple[Element, ...], frame: Frame) -> tuple[float, tuple[int, ...]]:
    """The best score of a frame and the slot of each element, -1 for none.

    The score adds the frame's log probability, each pair's slot_log or UNASSIGNED, log(1 - P(filled)) of slots that stay
    empty, and UNMATCHED_ADJACENT for an obligatory adjacent slot that stays empty. Dynamic programming over
    elements and sets of used slots; of equal scores the first in slot order is kept.
    """
    empty = [math.log(1 - s.filled) if s.filled < 1 else LOG_ZERO for s in frame.slots]
    empty = [e + (UNMATCHED_ADJACENT if s.obligatory and s.adjacent else 0) for e, s in zip(empty, frame.slots, strict=True)]
    states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for e in elements:
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (score, chosen) in states.items():
            options = [(i, slot_log(e, s)) for i, s in enumerate(frame.slots) if s.case in e.cases and not used >> i & 1]
            for i, gain in [*options, (-1, UNASSIGNED)]:
                key = used | (1 << i) if i >= 0 else used
                new = (score + gain, (*chosen, i))
                if key not in after or new[0] > after[key][0]:
                    after[key] = new
        states = after
    base = math.log(frame.probability) if frame.probability > 0 else LOG_UNKNOWN
    best = None
    for used, (score, chosen) in states.items():
        total = base + score + sum(e for i, e in enumerate(empty) if not used >> i & 1)
        if best is None or total > best[0] + 1e-12:
            best = (total, chosen)
    return best


ELEMENTS = "array<struct<word: string, cases: array<string>, adjacent: boolean>>"
FRAMES = (
    "array<struct<frame_id: string, probability: double, slots: array<struct<case: string, filled: double, obligatory: boolean, adjacent: boolean, "
    "words: array<string>, counts: array<double>>>>>"
)


def ranked(elements: str, frames: str, k: int) -> list[dict]:
    """best_frames of elements and frames as JSON texts."""
    own = tuple(Element(e["word"], tuple(e["cases"]), bool(e["adjacent"])) for e in json.loads(elements))
    known = [  # float: JSON has texts for NaN and the infinities
        Frame(f["frame_id"], float(f["probability"]), tuple(Slot(s["case"], dict(zip(s["words"], map(float, s["counts"]), strict=True)), float(s["filled"]), bool(s["obligatory"]), bool(s["adjacent"])) for s in f["slots"]))
        for f in json.loads(frames)
    ]
    return [{"frame_id": i, "score": float(score), "slots": list(slots)} for score, i, slots in best_frames(own, known, k)]


def assign_frames(rows: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """rows (keys, elements ELEMENTS, frames FRAMES) to (keys, rank, frame_id, score, slots): the k best frames of each predicate with the
    slot of each element, from 0, -1 for none. A predicate's frames are found by lookup_frames; each predicate is a row. Equal
    predicates of a batch are assigned once."""

    @F.arrow_udf("array<struct<frame_id: string, score: double, slots: array<int>>>")
    def run(elements, frames):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("frame_id", pa.string()), ("score", pa.float64()), ("slots", pa.list_(pa.int32()))]))
        es, fs = elements.dictionary_encode(), frames.dictionary_encode()
        pairs = np.array(es.indices).astype(np.int64) * max(1, len(fs.dictionary)) + np.array(fs.indices)
        which, of = np.unique(pairs, return_inverse=True)
        es, fs, wide = es.dictionary.to_pylist(), fs.dictionary.to_pylist(), max(1, len(fs.dictionary))
        return pa.array([ranked(es[w // wide], fs[w % wide], k) for w in which.tolist()], kind).take(pa.array(of))

    text = lambda c, kind: F.to_json(F.col(c).cast(kind), {"ignoreNullFields": "false"})
    # outer: from the plain form Catalyst infers a filter on the array, and assigns once more to push that down
    found = rows.select(*keys, run(text("elements", ELEMENTS), text("frames", FRAMES)).alias("found")).select(*keys, F.posexplode_outer("found").alias("rank", "f"))
    return found.where("rank IS NOT NULL").select(*keys, (F.col("rank") + 1).alias("rank"), "f.frame_id", "f.score", "f.slots")


def best_frames(elements: tuple[Element, ...], frames: list[Frame], k: int = 5) -> list[tuple[float, str, tuple[int, ...]]]:
    """The k best (score, frame id, slots), ties by more assigned elements, then by frame order."""
    scored = [(*assign(elements, f), i, f.frame_id) for i, f in enumerate(frames)]
    scored.sort(key=lambda x: (-round(x[0], 9), sum(s < 0 for s in x[1]), x[2]))
    return [(score, frame_id, slots) for score, slots, _, frame_id in scored[:k]]
