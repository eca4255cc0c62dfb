"""Morphological segmentation: a lattice of dictionary and unknown words, and its cheapest path."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORBIDDEN = math.inf


@dataclass(frozen=True)
class Word:
    surface: str
    lemma: str
    pos: str
    left: int = 0
    right: int = 0
    weight: float = 1.0
    reading: str = ""
    kind: str = "word"


@dataclass
class Grammar:
    """Costs. A connection cost of 0, or one that isn't there while `strict`, is forbidden."""

    class_cost: dict[str, float] = field(default_factory=dict)
    connection: dict[tuple[int, int], float] = field(default_factory=dict)
    word_weight: float = 1.0
    connection_weight: float = 4.0
    width: float = 0.0
    default_connection: float = 10.0
    strict: bool = False

    def join(self, left: int, right: int) -> float:
        cost = self.connection.get((left, right), 0 if self.strict else self.default_connection)
        return cost * self.connection_weight if cost else FORBIDDEN

    def cost(self, w: Word) -> float:
        return self.class_cost.get(w.pos, 10.0) * w.weight * self.word_weight


class Trie:
    """Words by surface; a walk yields all that begin at a place of the text, or of a character lattice."""

    def __init__(self, words: Iterable[Word]) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w.surface:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(w)

    def walk(self, lattice: list[list[tuple[str, float]]], start: int) -> Iterator[tuple[int, Word, float]]:
        """(end, word, extra cost); a lattice place lists (character, extra cost), the character "" for a deletion."""
        states = [(start, self.root, 0.0)]
        while states:
            at, node, extra = states.pop()
            if at >= len(lattice):
                continue
            for c, cost in lattice[at]:
                if c == "":
                    if node is not self.root:
                        states.append((at + 1, node, extra + cost))
                        for w in node.get("", ()):
                            yield at + 1, w, extra + cost
                elif c in node:
                    for w in node[c].get("", ()):
                        yield at + 1, w, extra + cost
                    states.append((at + 1, node[c], extra + cost))


def char_type(c: str) -> str:
    o = ord(c)
    if c == " " or c == "　":
        return "space"
    if 0x3041 <= o <= 0x309F:
        return "hiragana"
    if 0x30A0 <= o <= 0x30FF:
        return "katakana"
    if 0x4E00 <= o <= 0x9FFF or c in "々〆":
        return "kanji"
    if c.isdecimal():
        return "digit"
    return "letter" if c.isalpha() else "symbol"


SMALL = dict(zip("ぁぃぅぇぉァィゥェォ", "あいうえおアイウエオ", strict=True))
VOWELS = {v: row for v, row in (("あ", "あかさたなはまやらわがざだばぱ"), ("い", "いきしちにひみりぎじぢびぴ"), ("う", "うくすつぬふむゆるぐずづぶぷ"), ("え", "えけせてねへめれげぜでべぺ"), ("お", "おこそとのほもよろをごぞどぼぽ"))}


def character_lattice(text: str, extra: float = 3.0) -> list[list[tuple[str, float]]]:
    """Each place with its character and, at a cost, what it may stand for: a prolonged sound for the vowel before
    it or for nothing, a small vowel for the full one."""
    out: list[list[tuple[str, float]]] = []
    for i, c in enumerate(text):
        place = [(c, 0.0)]
        if c in "ー〜" and i:
            vowel = next((v for v, row in VOWELS.items() if text[i - 1] in row), None)
            place += [("", extra)] + ([(vowel, extra)] if vowel else [])
        if c in SMALL:
            place += [(SMALL[c], extra), ("", extra)]
        out.append(place)
    return out


def unknown_words(text: str, at: int) -> Iterator[Word]:
    """One character, or the run of a class for katakana (with the prolonged mark), letters (with the full stop) and
    digits; and a repetition of two to four characters of one class."""
    kind = char_type(text[at])
    end = at + 1
    if kind in ("katakana", "letter", "digit"):
        while end < len(text) and (char_type(text[end]) == kind or (kind == "katakana" and text[end] == "ー") or (kind == "letter" and text[end] == ".")):
            end += 1
    surface = text[at:end]
    yield Word(surface, surface, {"space": "Space", "digit": "Number", "symbol": "Symbol"}.get(kind, "Unknown"), kind="unknown", weight=1.0 if kind in ("space", "symbol", "digit") else 3.0)
    for n in range(2, 5):
        unit = text[at : at + n]
        if len(unit) == n and text[at + n : at + 2 * n] == unit and len(set(map(char_type, unit))) == 1 and kind in ("hiragana", "katakana") and len(set(unit)) > 1:
            yield Word(unit * 2, unit * 2, "Onomatopoeia", kind="repetition", weight=(2.4 if kind == "hiragana" else 2.0) / n + 0.5)


#: The runs of unknown_words: katakana with the prolonged mark, letters with the full stop, digits, else one character.
RUN = r"[\x{30A0}-\x{30FF}]+|\p{Nd}+|(?![\x{3005}-\x{3006}\x{3041}-\x{30FF}\x{4E00}-\x{9FFF}])\p{L}(?:(?![\x{3005}-\x{3006}\x{3041}-\x{30FF}\x{4E00}-\x{9FFF}])[\p{L}.])*|(?s:.)"


def unknown_runs(text: Column) -> Column:
    """array<string>: a text cut from left to right into the first unknown word at each place, as unknown_words gives it."""
    return F.regexp_extract_all(text, F.lit(RUN), F.lit(0))


def run_kind(run: Column) -> Column:
    """The kind of a run of unknown_runs: space, digit, letter, katakana, hiragana, kanji or symbol."""
    return (
        F.when(run.rlike(r"^[ \x{3000}]"), "space").when(run.rlike(r"^[\x{3041}-\x{309F}]"), "hiragana").when(run.rlike(r"^[\x{30A0}-\x{30FF}]"), "katakana")
        .when(run.rlike(r"^[\x{4E00}-\x{9FFF}\x{3005}\x{3006}]"), "kanji").when(run.rlike(r"^\p{Nd}"), "digit").when(run.rlike(r"^\p{L}"), "letter").otherwise("symbol")
    )


def is_repetition(word: Column, least: int = 2, most: int = 4) -> Column:
    """Whether the word is a unit of that many characters, not all the same, said twice."""
    n = F.char_length(word)
    half = (n / 2).cast("int")
    unit = word.substr(F.lit(1), half)
    return (n % 2 == 0) & half.between(least, most) & (word == F.repeat(unit, F.lit(2))) & ~word.rlike(r"^(.)\1*$")


@dataclass
class Node:
    start: int
    end: int
    word: Word
    score: float = FORBIDDEN
    before: list[Node] = field(default_factory=list, repr=False)


def analyse(text: str, trie: Trie, grammar: Grammar, alternatives: bool = False) -> list[Node]:
    """All live nodes of the lattice, the end node last. A node keeps the predecessors within `width` of its best one,
    best first; nodes that nothing reaches are dropped."""
    lattice = character_lattice(text) if alternatives else [[(c, 0.0)] for c in text]
    begin = Node(0, 0, Word("", "", "BOS"), 0.0)
    ends: dict[int, list[Node]] = defaultdict(list, {0: [begin]})
    out: list[Node] = [begin]
    for at in range(len(text)):
        if not ends[at]:
            continue
        found = [(end, w, extra) for end, w, extra in trie.walk(lattice, at)]
        found += [(at + len(w.surface), w, 0.0) for w in unknown_words(text, at) if not any(f[1].surface == w.surface for f in found)]
        best: dict[int, list[tuple[float, Node]]] = {}  # connections into this place, by left id
        for end, w, extra in found:
            if w.left not in best:
                best[w.left] = sorted(((n.score + grammar.join(n.word.right, w.left), n) for n in ends[at]), key=lambda x: x[0])
            options = best[w.left]
            if options[0][0] == FORBIDDEN:
                continue
            node = Node(at, end, w, options[0][0] + grammar.cost(w) + extra, [n for s, n in options if s <= options[0][0] + grammar.width])
            ends[end].append(node)
            out.append(node)
    last = [(n.score + grammar.join(n.word.right, 0), n) for n in ends[len(text)]]
    last.sort(key=lambda x: x[0])
    if last:
        out.append(Node(len(text), len(text), Word("", "", "EOS"), last[0][0], [n for s, n in last if s <= last[0][0] + grammar.width]))
    return out


def best_path(nodes: list[Node]) -> list[Node]:
    path, node = [], nodes[-1]
    while node.before:
        node = node.before[0]
        path.append(node)
    return path[::-1][1:]


def all_paths(nodes: list[Node]) -> Iterator[list[Node]]:
    """Every kept path, the best first at each node."""

    def back(node: Node, tail: list[Node]) -> Iterator[list[Node]]:
        if not node.before:
            yield tail[1:] if tail and tail[0].word.pos == "BOS" else tail
        for n in node.before:
            yield from back(n, [n, *tail])

    yield from back(nodes[-1], [])


def homographs(nodes: list[Node], path: list[Node]) -> list[list[Word]]:
    """For each place of the path the words of its span with the same score, the chosen one first."""
    return [[n.word, *(m.word for m in nodes if m is not n and (m.start, m.end) == (n.start, n.end) and math.isclose(m.score, n.score))] for n in path]


def join_numbers(path: list[Node]) -> list[Node]:
    out: list[Node] = []
    for n in path:
        if out and n.word.pos == out[-1].word.pos == "Number":
            p = out[-1]
            out[-1] = replace_node(p, n)
        else:
            out.append(n)
    return out


def replace_node(a: Node, b: Node) -> Node:
    word = replace(a.word, surface=a.word.surface + b.word.surface, lemma=a.word.lemma + b.word.lemma)
    return Node(a.start, b.end, word, b.score)


#: type -> form -> ending; the base form is `base`.
Endings = dict[str, dict[str, str]]


def inflect(word: str, kind: str, form: str, endings: Endings, source: str = "base") -> str | None:
    """word, in form `source`, in another form; None where the type has no such form or the ending doesn't fit."""
    forms = endings.get(kind, {})
    if source not in forms or form not in forms or not word.endswith(forms[source]):
        return None
    return word.removesuffix(forms[source]) + forms[form]


def compile_lexicon(rows: Iterable[dict], endings: Endings) -> list[Word]:
    """One Word per inflected form: rows have surface (base form), pos, and may have kind, left, right, weight, reading."""
    out = []
    for r in rows:
        own = {k: r[k] for k in ("left", "right", "weight", "reading") if k in r}
        forms = endings.get(r.get("kind", ""), {"base": ""})
        for form in forms:
            surface = inflect(r["surface"], r["kind"], form, endings) if r.get("kind") in endings else r["surface"]
            if surface:
                out.append(Word(surface, r["surface"], r["pos"], **own))
    return out


def compile_connections(rules: Iterable[tuple[Iterable[int], Iterable[int], float]]) -> dict[tuple[int, int], float]:
    """The cost matrix from rules (left ids, right ids, cost): the least cost of the rules that name a pair."""
    out: dict[tuple[int, int], float] = {}
    for lefts, rights, cost in rules:
        for a in lefts:
            for b in rights:
                out[a, b] = min(cost, out.get((a, b), cost))
    return out


#: How many morphemes a task holds as objects at a time, beside those of one text.
HELD = 20_000


def segment_frames(frames: Iterable[pd.DataFrame], key: str, text: str, trie: Trie, grammar: Grammar) -> Iterator[pd.DataFrame]:
    """The morphemes of frames of texts, in frames of HELD or little more: a batch of texts isn't held as objects whole."""
    columns = [key, "morph_no", "surface", "lemma", "pos", "start", "cost"]
    for pdf in frames:
        out = []
        for k, t in zip(pdf[key], pdf[text], strict=True):
            for i, n in enumerate(join_numbers(best_path(analyse(t, trie, grammar))) if t else []):
                out.append((k, i, n.word.surface, n.word.lemma, n.word.pos, n.start, n.score))
            if len(out) >= HELD:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)


def segment(rows: DataFrame, key: str, text: str, words: list[Word], grammar: Grammar) -> DataFrame:
    """(key, morph_no, surface, lemma, pos, start, cost) of the best path of every text. The lexicon goes out once."""
    held = rows.sparkSession.sparkContext.broadcast((words, grammar))
    tries: list[Trie] = []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, costs = held.value
        if not tries:
            tries.append(Trie(lexicon))
        return segment_frames(frames, key, text, tries[0], costs)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, morph_no int, surface string, lemma string, pos string, start int, cost double")
