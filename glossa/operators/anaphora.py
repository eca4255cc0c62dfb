"""Entities of an article: coreference, salience and zero anaphora, one article at a time.

The relational parts (nearest antecedent, decayed salience) are in discourse; here is the search that fills the open
slots of predicates with entities and so can't be stated as a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: Weights of a mention by its role; other roles weigh OTHER.
ROLE_WEIGHT = {"topic": 2.0, "appositive": 2.0, "end": 2.0, "subject": 1.0, "object": 1.0, "comma": 1.0, "zero": 1.0, "associative": 0.0}
OTHER, DECAY = 0.4, 0.5
#: Entities that no phrase names.
PSEUDO = ("author", "reader", "person", "thing", "clause")


@dataclass(frozen=True)
class Phrase:
    """A noun phrase (predicate False) with its role, or a predicate with its open slots. head is the phrase it depends
    on in its sentence; kind is a named-entity type or empty."""

    word: str
    sentence: int
    role: str = ""
    kind: str = ""
    predicate: bool = False
    slots: tuple[str, ...] = ()
    head: int = -1
    reading: str = ""


@dataclass
class Entity:
    name: str
    kind: str = ""
    mentions: list[tuple[int, float]] = field(default_factory=list)
    pseudo: bool = False

    def salience(self, sentence: int) -> float:
        if self.pseudo:
            return 1.0
        return sum(w * DECAY ** (sentence - s) for s, w in self.mentions if s <= sentence)

    def last(self) -> int:
        return max((s for s, _ in self.mentions), default=-(10**6))


def strip_common(a: str, b: str) -> tuple[str, str]:
    """The two words without the prefix and the suffix that they share."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j = 0
    while j < min(len(a), len(b)) and a[-1 - j] == b[-1 - j]:
        j += 1
    return (a[: len(a) - j], b[: len(b) - j])


def same_entity(a: Phrase, b: Phrase, synonyms: frozenset[tuple[str, str]] = frozenset(), apart: int = 0) -> bool:
    """Whether later phrase a may name what b names: equal words, a shorter form of a person's or a place's name,
    synonyms, with a shared prefix and suffix removed too, or a person's reading near by. Kinds must agree."""
    if a.kind and b.kind and a.kind != b.kind:
        return False
    if a.word == b.word:
        return True
    if b.kind == "PERSON" and len(a.word) > 1 and b.word.startswith(a.word):
        return True
    if b.kind == "LOCATION" and b.word[:-1] == a.word:
        return True
    related = lambda x, y: (x, y) in synonyms or (y, x) in synonyms
    if related(a.word, b.word) or related(*strip_common(a.word, b.word)):
        return True
    return "PERSON" in (a.kind, b.kind) and bool(a.reading) and a.reading == b.reading and apart <= 10


Scorer = Callable[[Phrase, str, Entity, int], float]


def default_score(predicate: Phrase, slot: str, entity: Entity, sentence: int) -> float:
    """Log-linear score of an entity in a slot: salience, distance, whether its kind suits the slot."""
    near = sentence - entity.last()
    suits = {"subject": ("PERSON", "ORGANIZATION"), "object": ("ARTIFACT", ""), "dative": ("PERSON", "LOCATION", "ORGANIZATION")}
    score = 1.2 * math.log(max(entity.salience(sentence), 1e-6)) + (1.0 if entity.kind in suits.get(slot, ()) else 0.0)
    return score - (2.5 if entity.pseudo else 0.3 * min(near, 10))


@dataclass
class Article:
    """The state of an article: entities and which phrase names which."""

    entities: list[Entity] = field(default_factory=lambda: [Entity(p, pseudo=True) for p in PSEUDO])
    known: list[tuple[Phrase, int]] = field(default_factory=list)
    synonyms: frozenset[tuple[str, str]] = frozenset()

    def refer(self, phrase: Phrase, reach: int = 20) -> int:
        """The entity of a noun phrase: that of the nearest earlier match within `reach` sentences, else a new one."""
        entity = -1
        for back, (other, known) in enumerate(reversed(self.known), 1):
            if phrase.sentence - other.sentence > reach:
                break
            if same_entity(phrase, other, self.synonyms, back):
                entity = known
                break
        if entity < 0:
            self.entities.append(Entity(phrase.word, phrase.kind))
            entity = len(self.entities) - 1
        e = self.entities[entity]
        e.kind = e.kind or phrase.kind
        e.mentions.append((phrase.sentence, ROLE_WEIGHT.get(phrase.role, OTHER)))
        self.known.append((phrase, entity))
        return entity

    def candidates(self, sentence: int, named: int = 3, other: int = 1) -> list[int]:
        """Pseudo-entities, named entities within `named` sentences, others within `other`."""
        return [i for i, e in enumerate(self.entities) if e.pseudo or sentence - e.last() <= (named if e.kind else other)]

    def analyse(self, phrases: Sequence[Phrase], score: Scorer = default_score, keep: int = 10) -> list[tuple[int, str, int, bool]]:
        """(phrase, slot, entity, overt) of a sentence's predicates. Those with a topic below them are first, then the rest,
        each from the right; a filled slot is a mention for those that follow."""
        entity = {i: self.refer(p) for i, p in enumerate(phrases) if not p.predicate}
        out: list[tuple[int, str, int, bool]] = []
        predicates = [i for i, p in enumerate(phrases) if p.predicate]
        topical = {p.head for p in phrases if p.role == "topic"}
        for i in sorted(predicates, key=lambda i: (i not in topical, -i)):
            p = phrases[i]
            overt = {phrases[k].role if phrases[k].role in p.slots else ("subject" if phrases[k].role == "topic" and "subject" in p.slots else ""): entity[k] for k in entity if phrases[k].head == i}
            overt.pop("", None)
            parent = entity.get(p.head)
            open_slots = [s for s in p.slots if s not in overt]
            best = best_filling(p, open_slots, [c for c in self.candidates(p.sentence) if c not in overt.values() and c != parent], self.entities, score, keep)
            out += [(i, s, e, True) for s, e in overt.items()]
            for s, e in best[0][1] if best else ():
                out.append((i, s, e, False))
                self.entities[e].mentions.append((p.sentence, ROLE_WEIGHT["zero"]))
        return out


def best_filling(p: Phrase, slots: Sequence[str], entities: Sequence[int], known: Sequence[Entity], score: Scorer, keep: int, least: float = -3.0) -> list[tuple[float, tuple[tuple[str, int], ...]]]:
    """The `keep` best ways to fill the slots with different entities, slot by slot with a beam; a slot may stay empty
    at `least`."""
    states: list[tuple[float, tuple[tuple[str, int], ...]]] = [(0.0, ())]
    for s in slots:
        scored = [(score(p, s, known[e], p.sentence), e) for e in entities]
        after = [(total + least, filled) for total, filled in states]
        after += [(total + v, (*filled, (s, e))) for total, filled in states for v, e in scored if e not in {x for _, x in filled}]
        states = sorted(after, key=lambda x: (-x[0], x[1]))[:keep]
    return states


@dataclass(frozen=True)
class Decision:
    """One line of a decision list: where feature is at least (or at most) a threshold, the class and its confidence."""

    feature: str
    threshold: float
    label: str
    confidence: float
    at_least: bool = True


def decide(rules: Sequence[Decision], features: dict[str, float], default: tuple[str, float] = ("no", 0.5)) -> tuple[str, float]:
    for r in rules:
        v = features.get(r.feature)
        if v is not None and (v >= r.threshold if r.at_least else v <= r.threshold):
            return r.label, r.confidence
    return default


def decide_column(rules: Sequence[Decision], default: str = "no"):
    """The same list as a column over columns of the features' names."""
    from pyspark.sql import functions as F

    out = None
    for r in rules:
        test = (F.col(r.feature) >= r.threshold) if r.at_least else (F.col(r.feature) <= r.threshold)
        out = F.when(test, F.lit(r.label)) if out is None else out.when(test, F.lit(r.label))
    return F.lit(default) if out is None else out.otherwise(default)


def tournament(candidates: Sequence, better: Callable[[object, object], bool]):
    """The winner when each candidate meets the best so far, nearest first (twin-candidate ranking)."""
    best = None
    for c in candidates:
        if best is None or better(c, best):
            best = c
    return best


def author_reader(texts: Sequence[str]) -> tuple[float, float]:
    """How much an article speaks of its author and of its reader: shares of sentences with words of the first and of
    the second person."""
    import re

    first = re.compile(r"\b(?:i|we|my|our|ich|wir|je|nous|yo|nosotros)\b|私|僕|我々", re.I)
    second = re.compile(r"\b(?:you|your|du|sie|ihr|tu|vous|usted)\b|あなた|皆さん", re.I)
    n = max(len(texts), 1)
    return sum(bool(first.search(t or "")) for t in texts) / n, sum(bool(second.search(t or "")) for t in texts) / n


def resolve_articles(phrases: DataFrame, article: str) -> DataFrame:
    """phrases (article, sentence, phrase, word, role, kind, predicate, slots, head) to (article, sentence, phrase, slot,
    entity, overt). An article is one group; sentences are in order whatever the order of rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = Article(), []
        for s, own in pdf.sort_values(["sentence", "phrase"]).groupby("sentence"):
            units = [Phrase(r.word, int(s), r.role or "", r.kind or "", bool(r.predicate), tuple(r.slots) if r.slots is not None else (), int(r.head)) for r in own.itertuples()]
            out += [(int(s), i, slot, state.entities[e].name, overt) for i, slot, e, overt in state.analyse(units)]
        found = pd.DataFrame(out, columns=["sentence", "phrase", "slot", "entity", "overt"])
        found.insert(0, article, pdf[article].iloc[0])
        return found

    kind = phrases.schema[article].dataType.simpleString()
    return phrases.groupBy(article).applyInPandas(run, f"{article} {kind}, sentence int, phrase int, slot string, entity string, overt boolean")

