"""Named tests of a unit among its neighbours, for rule patterns: `&name` or `&name:argument`.

A test gets the units of a sentence, the place and the argument. Units have attributes (surface, lemma, pos, ...),
features and parts; the head of a unit is the attribute `head`, the place of its governor, where it is known.
"""

from __future__ import annotations

import operator
import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping
from functools import lru_cache

from glossa.operators.rules import Unit

Function = Callable[[list[Unit], int, str], bool]

# The ranges of scripts, and the order of clause levels.
RANGES = {"hiragana": ((0x3041, 0x309F), (0x30FC, 0x30FC)), "katakana": ((0x30A0, 0x30FF),), "kanji": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x3005, 0x3007))}
LEVELS = ("A-", "A", "B-", "B", "B+", "C")


@lru_cache(1 << 14)
def classes(c: str) -> frozenset[str]:
    """The classes that a character belongs to: hiragana, katakana, kanji, digit, letter, symbol."""
    code, kind = ord(c), unicodedata.category(c)
    out = {name for name, ranges in RANGES.items() if any(a <= code <= z for a, z in ranges)}
    if kind[0] == "N":
        out.add("digit")
    elif kind[0] in "PS":
        out.add("symbol")
    elif kind[0] == "L" and not out:
        out.add("letter")
    return frozenset(out)


def _text(units: list[Unit], at: int) -> str:
    return units[at].attributes.get("surface", "")


def _every(*names: str) -> Function:
    wanted = frozenset(names)
    return lambda units, at, _: bool(_text(units, at)) and all(classes(c) & wanted for c in _text(units, at))


def _any(*names: str) -> Function:
    wanted = frozenset(names)
    return lambda units, at, _: any(classes(c) & wanted for c in _text(units, at))


def _mixed(units: list[Unit], at: int, _: str) -> bool:
    found = [classes(c) for c in _text(units, at)]
    return bool(found) and not frozenset.intersection(*found)


COMPARISONS = {"lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


@lru_cache(1 << 14)
def _number(text: str) -> float | None:
    return float(text) if re.fullmatch(r"-?[0-9]+(?:\.[0-9]+)?", text) else None


@lru_cache(1 << 15)
def compare(left: str, sign: str, right: str) -> bool:
    """left lt, le, gt or ge right: as numbers where both are, else as text; eq is equality of texts."""
    a, b = _number(left), _number(right)
    x, y = (a, b) if a is not None and b is not None else (left, right)
    return COMPARISONS[sign](x, y) if sign != "eq" else left == right


@lru_cache(1 << 10)
def _bound(argument: str) -> tuple[str, str]:
    sign, colon, bound = argument.partition(":")
    return (sign, bound) if colon else ("ge", argument)


def _compared(value: Callable[[list[Unit], int], str | None]) -> Function:
    """A test `sign:bound` of a value; a bare bound means at least that."""

    def test(units: list[Unit], at: int, argument: str) -> bool:
        own = value(units, at)
        return own is not None and compare(own, *_bound(argument))

    return test


def _members(text: str | None) -> set[str]:
    return set((text or "").split(";")) - {""}


def _governor(units: list[Unit], at: int) -> int | None:
    head = _number(units[at].attributes.get("head", ""))
    return int(head) if head is not None and 0 <= head < len(units) else None


def _dependents(units: list[Unit], at: int) -> Iterable[int]:
    return (i for i in range(len(units)) if i != at and _governor(units, i) == at)


def _parts(units: list[Unit], at: int) -> list[Unit]:
    return units[at].parts or [units[at]]


def level_at_least(own: str | None, bound: str | None) -> bool:
    """Whether a clause level is as strong; a missing own one holds, a missing bound doesn't."""
    if own not in LEVELS:
        return True
    return bound in LEVELS and LEVELS.index(own) >= LEVELS.index(bound)


def _tail(units: list[Unit], at: int, argument: str) -> bool:
    """The last parts have the surfaces of the argument, joined by `+`."""
    want = argument.split("+")
    return [p.attributes.get("surface", "") for p in _parts(units, at)][-len(want) :] == want


def _at_offset(test: Function) -> Function:
    """A test of the unit n away: `n:argument`."""

    def run(units: list[Unit], at: int, argument: str) -> bool:
        n, _, rest = argument.partition(":")
        return 0 <= at + int(n) < len(units) and test(units, at + int(n), rest)

    return run


def _same(attribute: str) -> Function:
    """The attribute equals that of the unit n away, and isn't missing."""

    def test(units: list[Unit], at: int, argument: str) -> bool:
        there = at + int(argument)
        return 0 <= there < len(units) and bool(own := units[at].attributes.get(attribute)) and own == units[there].attributes.get(attribute)

    return test


def _has(units: list[Unit], at: int, argument: str) -> bool:
    return units[at].has(argument)


def _feature(units: list[Unit], at: int, argument: str) -> bool:
    """`name:sign:bound`: the value of a feature against a bound."""
    name, sign, bound = argument.split(":", 2)
    own = units[at].value(name)
    return own is not None and compare(own, sign, bound)


FUNCTIONS: dict[str, Function] = {
    "feature": _feature,
    "symbol": _every("symbol"),
    "kanji": _every("kanji"),
    "hiragana": _every("hiragana"),
    "katakana": _every("katakana"),
    "kana_or_kanji": _every("hiragana", "katakana", "kanji"),
    "digit": _every("digit"),
    "letter": _every("letter"),
    "has_symbol": _any("symbol"),
    "has_kana": _any("hiragana", "katakana"),
    "has_letter_or_digit": _any("letter", "digit"),
    "mixed": _mixed,
    "ends_in_hiragana": lambda u, i, _: "hiragana" in classes(_text(u, i)[-1:] or " "),
    "ends_with": lambda u, i, a: _text(u, i).endswith(a),
    "starts_with": lambda u, i, a: _text(u, i).startswith(a),
    "single": lambda u, i, _: len(_text(u, i)) == 1,
    "length": _compared(lambda u, i: str(len(_text(u, i)))),
    "digits": _compared(lambda u, i: str(sum("digit" in classes(c) for c in _text(u, i)))),
    "parts": _compared(lambda u, i: str(len(_parts(u, i)))),
    "number": _compared(lambda u, i: _text(u, i)),
    "tail": _tail,
    "category": lambda u, i, a: a in _members(u[i].value("category")),
    "semantic": lambda u, i, a: a in _members(u[i].attributes.get("sem")),
    "semantic_of_head": lambda u, i, a: a in _members(_parts(u, i)[-1].attributes.get("sem")),
    "semantic_of_all": lambda u, i, a: all(a in _members(p.attributes.get("sem")) for p in _parts(u, i)),
    "case": lambda u, i, a: a in _members(u[i].value("cases")),
    "level": lambda u, i, a: level_at_least(u[i].value("level"), a),
    "stronger_than": lambda u, i, a: 0 <= i + int(a) < len(u) and level_at_least(u[i].value("level"), u[i + int(a)].value("level")),
    "within": lambda u, i, a: (g := _governor(u, i)) is not None and abs(g - i) <= int(a),
    "governor_has": lambda u, i, a: (g := _governor(u, i)) is not None and u[g].has(a),
    "dependent_has": lambda u, i, a: any(u[k].has(a) for k in _dependents(u, i)),
    "dependents_all_have": lambda u, i, a: all(u[k].has(a) for k in _dependents(u, i)),
    "no_dependent": lambda u, i, _: not any(True for _ in _dependents(u, i)),
    "at": _at_offset(_has),
    "text_at": _at_offset(lambda u, i, a: _text(u, i) == a),
    "same_lemma": _same("lemma"),
    "same_surface": _same("surface"),
    "same_pos": _same("pos"),
    "time": lambda u, i, _: "time" in _members(u[i].attributes.get("sem")) or u[i].has("time"),
    "voice": lambda u, i, a: a in (u[i].value("voice") or "").split("&"),
    "first": lambda u, i, _: i == 0,
    "last": lambda u, i, _: i == len(u) - 1,
    "ambiguous": lambda u, i, _: u[i].has("ambiguous") or any(f.startswith("ALT-") for f in u[i].features),
}


def with_tables(
    similarity: Mapping[tuple[str, str], float] | None = None, mi_rank: Mapping[tuple[str, str], int] | None = None, options: Iterable[str] = (), lexicon: Iterable[str] = ()
) -> dict[str, Function]:
    """FUNCTIONS with those that read tables or settings: `similar:n:bound` of the lemmas of two units, `mi_rank:n:bound` of a noun and
    the verb n away, `option:name`, `known` (the lemma is in a lexicon)."""
    known, words = set(options), set(lexicon)

    def pair(table: Mapping, least: bool) -> Function:
        def test(units: list[Unit], at: int, argument: str) -> bool:
            n, _, bound = argument.partition(":")
            there = at + int(n)
            if not 0 <= there < len(units):
                return False
            a, b = units[at].attributes.get("lemma", ""), units[there].attributes.get("lemma", "")
            value = table.get((a, b), table.get((b, a)) if least else None)
            return value is not None and (value >= float(bound) if least else value <= float(bound))

        return test

    return FUNCTIONS | {
        "similar": pair(similarity or {}, True),
        "mi_rank": pair(mi_rank or {}, False),
        "option": lambda u, i, a: a in known,
        "known": lambda u, i, _: u[i].attributes.get("lemma", "") in words,
    }
