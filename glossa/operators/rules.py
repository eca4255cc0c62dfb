"""Rules over the units of a sentence: patterns on token sequences, contexts, loops and actions.

Rules whose order doesn't matter inside a sentence compile to columns (functions.features.dnf). The rest, where a
rule sees what earlier ones did to neighbours, run here, one sentence at a time, under mapInPandas.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(slots=True)
class Unit:
    """A morpheme, basic phrase or phrase: attributes and ordered features."""

    attributes: dict[str, str]
    features: list[str] = field(default_factory=list)
    parts: list[Unit] = field(default_factory=list)

    def has(self, term: str) -> bool:
        return any(f == term or f.startswith(term + ":") for f in self.features)

    def value(self, term: str) -> str | None:
        return next((f[len(term) + 1 :] for f in self.features if f == term or f.startswith(term + ":")), None)

    def put(self, feature: str) -> None:
        name = _name(feature)
        for i, f in enumerate(self.features):
            if _name(f) == name:
                self.features[i] = feature
                return
        self.features.append(feature)

    def drop(self, term: str) -> None:
        self.features = [f for f in self.features if not (f == term or f.startswith(term + ":"))]


def _name(feature: str) -> str:
    if '"' not in feature:
        return feature.partition(":")[0]
    quoted = False
    for i, c in enumerate(feature):
        quoted ^= c == '"'
        if c == ":" and not quoted:
            return feature[:i]
    return feature


Function = Callable[[list[Unit], int, str], bool]


@dataclass(frozen=True)
class Pattern:
    """One place of a sequence: attribute sets (^ first for none of them), a DNF of features, a repeat mark.

    `parts` is a pattern on the unit's own parts, for phrases by their morphemes.
    """

    attributes: tuple[tuple[str, tuple[str, ...]], ...] = ()
    features: tuple[tuple[str, ...], ...] = ()
    repeat: str = ""
    parts: tuple[Pattern, ...] | None = None

    def fits(self, units: list[Unit], at: int, functions: Mapping[str, Function]) -> bool:
        unit = units[at]
        for name, allowed in self.attributes:
            found = unit.attributes.get(name, "") in allowed
            if allowed and allowed[0] == "^":
                found = unit.attributes.get(name, "") not in allowed[1:]
            if not found:
                return False
        if self.features and not any(all(self._term(t, units, at, functions) for t in terms) for terms in self.features):
            return False
        return self.parts is None or len(unit.parts) in lengths(self.parts, unit.parts, 0, 1, functions)

    @staticmethod
    def _term(term: str, units: list[Unit], at: int, functions: Mapping[str, Function]) -> bool:
        bare = term.removeprefix("^")
        if bare.startswith("&"):
            name, _, argument = bare[1:].partition(":")
            found = functions[name](units, at, argument)
        else:
            found = units[at].has(bare)
        return found != term.startswith("^")


def lengths(patterns: Sequence[Pattern], units: list[Unit], start: int, step: int, functions: Mapping[str, Function]) -> set[int]:
    """How many units from `start` in direction `step` the patterns can take: the states of an NFA, run once."""
    order = patterns if step > 0 else patterns[::-1]

    def closed(states: set[int]) -> set[int]:
        out = set(states)
        for s in sorted(states):
            while s < len(order) and order[s].repeat in ("*", "?"):
                s += 1
                out.add(s)
        return out

    states, taken, done = closed({0}), 0, set()
    while True:
        if len(order) in states:
            done.add(taken)
        at = start + step * taken
        if not states or not 0 <= at < len(units):
            return done
        following = set()
        for s in states:
            if s < len(order) and order[s].fits(units, at, functions):
                following.add(s if order[s].repeat == "*" else s + 1)
                if order[s].repeat == "*":
                    following.add(s + 1)
        states, taken = closed(following), taken + 1


@dataclass(frozen=True)
class Rule:
    """Left context, self and right context, and actions. A left of None stands for the start of the sentence, a
    right of None for anything, a self of None for one unit."""

    actions: tuple[str, ...]
    self_: tuple[Pattern, ...] | None = None
    left: tuple[Pattern, ...] | None = ()
    right: tuple[Pattern, ...] | None = None

    def span(self, units: list[Unit], at: int, functions: Mapping[str, Function]) -> int:
        """The longest self at `at` whose contexts match; 0 for no match."""
        if self.left is None:
            if at:
                return 0
        elif self.left and not lengths(self.left, units, at - 1, -1, functions):
            return 0
        own = {1} if self.self_ is None else lengths(self.self_, units, at, 1, functions) - {0}
        for n in sorted(own, reverse=True):
            if self.right is None or lengths(self.right, units, at + n, 1, functions):
                return n
        return 0


#: What an action that needs more than the unit can use: words known to an automatic dictionary, case and number of compound
#: particles by their text.
@dataclass
class Tables:
    lexicon: frozenset[str] = frozenset()
    particles: Mapping[str, tuple[str, int]] = field(default_factory=dict)


NO_TABLES = Tables()
#: How many units a task holds as objects at a time, beside those of a longer sentence.
HELD = 50_000
NO_FUNCTIONS: Mapping[str, Function] = {}


def act(units: list[Unit], at: int, offset: int, action: str, tables: Tables = NO_TABLES) -> None:
    """One action on a unit of a matched span.

    `^x` deletes a feature, `n|action` acts at offset n of the span only, anything without a sign adds a feature. With a sign:
    pos, lemma, sem and other names set attributes; copy:attribute:name stores an attribute as a feature; spread:n:f gives f to
    the unit n away; case:x adds a surface case, uncase:x takes it away, cases clears them, cases:x;y sets them; memo:text adds to
    the notes of the sentence, on its first unit; particle and particle_id store the case and the number of a compound particle;
    remember:attribute keeps an attribute and recall:attribute:name, after it in the sentence, stores it as a feature; function
    makes a content unit a function one; known:f adds f where the lexicon has the lemma.
    """
    if "|" in action:
        where, _, rest = action.partition("|")
        if rest and where.isdigit():
            if int(where) != offset:
                return
            action = rest
    unit = units[at]
    if action.startswith("^"):
        unit.drop(action[1:])
        return
    if not action.startswith("&"):
        unit.put(action)
        return
    name, _, argument = action[1:].partition(":")
    cases = [c for c in (unit.value("cases") or "").split(";") if c]
    if name == "spread":
        n, _, feature = argument.partition(":")
        if 0 <= at + int(n) < len(units):
            units[at + int(n)].put(feature)
    elif name == "copy":
        attribute, _, feature = argument.partition(":")
        unit.put(f"{feature}:{unit.attributes.get(attribute, '')}")
    elif name == "case":
        unit.put("cases:" + ";".join([*cases, argument] if argument not in cases else cases))
    elif name == "uncase":
        unit.put("cases:" + ";".join(c for c in cases if c != argument))
    elif name == "cases":
        unit.put("cases:" + argument) if argument else unit.drop("cases")
    elif name == "memo":
        notes = units[0].value("memo")
        units[0].put("memo:" + (f"{notes} {argument}" if notes else argument))
    elif name in ("particle", "particle_id"):
        found = tables.particles.get(unit.attributes.get("surface", ""))
        if found:
            unit.put(f"{name}:{found[name == 'particle_id']}")
    elif name == "remember":
        units[0].attributes[f"&{argument}"] = unit.attributes.get(argument, "")
    elif name == "recall":
        attribute, _, feature = argument.partition(":")
        if f"&{attribute}" in units[0].attributes:
            unit.put(f"{feature}:{units[0].attributes[f'&{attribute}']}")
    elif name == "function":
        unit.drop("content")
        unit.put("function")
    elif name == "known":
        if unit.attributes.get("lemma", "") in tables.lexicon:
            unit.put(argument)
    else:
        unit.attributes[name] = argument


Span = Callable[[list[Unit], int], int]


def compiled(rule: Rule, functions: Mapping[str, Function]) -> Span:
    """rule.span as one function: a side of one place without a repeat is tested as it stands, the unit's own place first, since it
    mostly decides; other sides go through `lengths`."""
    own = None if rule.self_ is None else _single(rule.self_, functions)
    if rule.self_ is not None and own is None:
        return lambda units, at: rule.span(units, at, functions)
    left, right = _side(rule.left, -1, functions), None if rule.right is None else _side(rule.right, 1, functions)
    if rule.left is None:
        left = lambda units, at: not at
    elif not rule.left:
        left = None
    tests = [t for t in (own, left, right) if t]
    if not tests:
        return lambda units, at: 1
    if len(tests) == 1:
        only = tests[0]
        return lambda units, at: 1 if only(units, at) else 0
    one, two, *rest = tests
    if not rest:
        return lambda units, at: 1 if one(units, at) and two(units, at) else 0
    three = rest[0]
    return lambda units, at: 1 if one(units, at) and two(units, at) and three(units, at) else 0


def _side(patterns: Sequence[Pattern] | None, step: int, functions: Mapping[str, Function]) -> Callable[[list[Unit], int], bool] | None:
    if not patterns:
        return None
    single = _single(patterns, functions)
    if single is None:
        return lambda units, at: bool(lengths(patterns, units, at + step, step, functions))
    if step < 0:
        return lambda units, at: at > 0 and single(units, at - 1)
    return lambda units, at: at + 1 < len(units) and single(units, at + 1)


def _single(patterns: Sequence[Pattern], functions: Mapping[str, Function]) -> Callable[[list[Unit], int], bool] | None:
    """The test of one place without a repeat; None for other sequences."""
    if len(patterns) != 1 or patterns[0].repeat:
        return None
    p = patterns[0]
    if p.parts is None and not p.features and len(p.attributes) == 1:
        name, allowed = p.attributes[0]
        if allowed and allowed[0] == "^":
            barred = frozenset(allowed[1:])
            return lambda units, at: units[at].attributes.get(name, "") not in barred
        if len(allowed) == 1:
            word = allowed[0]
            return lambda units, at: units[at].attributes.get(name, "") == word
        wanted = frozenset(allowed)
        return lambda units, at: units[at].attributes.get(name, "") in wanted
    if p.parts is None and not p.attributes and len(p.features) == 1:
        terms = [_term(t, functions) for t in p.features[0]]
        if len(terms) == 1:
            return terms[0]
        if len(terms) == 2:
            one, two = terms
            return lambda units, at: one(units, at) and two(units, at)
        return lambda units, at: all(t(units, at) for t in terms)
    return lambda units, at: p.fits(units, at, functions)


def _term(term: str, functions: Mapping[str, Function]) -> Callable[[list[Unit], int], bool]:
    wanted, bare = not term.startswith("^"), term.removeprefix("^")
    if bare.startswith("&"):
        name, _, argument = bare[1:].partition(":")
        if name not in functions:  # it fails where it is reached, as ever
            return lambda units, at: bool(functions[name](units, at, argument)) == wanted
        test = functions[name]
        if wanted:
            return lambda units, at: bool(test(units, at, argument))
        return lambda units, at: not test(units, at, argument)
    head = bare + ":"

    def has(units: list[Unit], at: int) -> bool:
        for f in units[at].features:
            if f == bare or f.startswith(head):
                return wanted
        return not wanted

    return has


_compiled: dict[tuple[int, int], tuple[Sequence[Rule], Mapping[str, Function], list[Span]]] = {}


def _spans(rules: Sequence[Rule], functions: Mapping[str, Function]) -> list[Span]:
    """The compiled spans of a tuple of rules, kept for the next sentence; held with what they were made of, so ids stay theirs."""
    if not isinstance(rules, tuple):
        return [compiled(r, functions) for r in rules]
    key = id(rules), id(functions)
    found = _compiled.get(key)
    if found is None or found[0] is not rules or found[1] is not functions:
        if len(_compiled) > 256:
            _compiled.clear()
        found = _compiled[key] = (rules, functions, [compiled(r, functions) for r in rules])
    return found[2]


def apply(
    rules: Sequence[Rule], units: list[Unit], *, by: str = "unit", leave: str = "none", backwards: bool = False,
    functions: Mapping[str, Function] | None = None, tables: Tables = NO_TABLES,
) -> list[Unit]:
    """Apply rules in place. by: unit (all rules at a unit, then the next) or rule. leave: none, normal (after a match
    stop the inner loop) or jump (by unit: also skip the matched span)."""
    functions = NO_FUNCTIONS if functions is None else functions
    spans = _spans(rules, functions)
    places = range(len(units) - 1, -1, -1) if backwards else range(len(units))

    def fire(rule: Rule, at: int, n: int) -> None:
        for k in range(n):
            for action in rule.actions:
                act(units, at + k, k, action, tables)

    if by == "rule":
        for rule, span in zip(rules, spans, strict=True):
            for at in places:
                if n := span(units, at):
                    fire(rule, at, n)
                    if leave != "none":
                        break
        return units
    skip: set[int] = set()
    both = list(zip(rules, spans, strict=True))
    for at in places:
        if at in skip:
            continue
        for rule, span in both:
            if n := span(units, at):
                fire(rule, at, n)
                if leave != "none":
                    if leave == "jump":
                        skip.update(range(at, at + n))
                    break
    return units


@dataclass(frozen=True)
class RuleSet:
    """Rules of one kind with the way in which they run. level: morpheme rules see the units, phrase rules what units are parts of."""

    kind: str
    rules: tuple[Rule, ...]
    by: str = "unit"
    leave: str = "none"
    backwards: bool = False
    level: str = "unit"


def dispatch(sets: Sequence[RuleSet], kind: str, units: list[Unit], functions: Mapping[str, Function] | None = None, tables: Tables = NO_TABLES) -> list[Unit]:
    """Every set of the kind, in the order of the sets; a set of level `parts` runs over the parts of each unit."""
    for s in sets:
        if s.kind == kind:
            for own in [u.parts for u in units] if s.level == "parts" else [units]:
                apply(s.rules, own, by=s.by, leave=s.leave, backwards=s.backwards, functions=functions, tables=tables)
    return units


def choose_homograph(alternatives: list[Unit], rules: Sequence[Sequence[Pattern]]) -> tuple[int, list[str]]:
    """(chosen index, ALT- features of the others). A rule applies when each alternative fits some element and each
    element some alternative; it prefers the alternatives that fit its first element. Else the first is kept."""
    chosen = 0
    for elements in rules:
        fits = [[p.fits(alternatives, i, {}) for p in elements] for i in range(len(alternatives))]
        if all(map(any, fits)) and all(any(row[j] for row in fits) for j in range(len(elements))):
            chosen = next(i for i, row in enumerate(fits) if row[0])
            break
    keep = alternatives[chosen].attributes
    others = [f"ALT-{a.attributes.get('surface', '')}:{a.attributes.get('lemma', '')}" for i, a in enumerate(alternatives) if i != chosen]
    if any(a.attributes.get("lemma") != keep.get("lemma") for a in alternatives):
        others.append("ambiguous")
    return chosen, others


@lru_cache(256)
def parse_pattern(notation: str) -> tuple[Pattern, ...]:
    """A pattern from one line: places in brackets, as in `[pos=Noun|Verb lemma=^be]* [feature & ^other]?`."""
    import re

    out = []
    for body, repeat in re.findall(r"\[([^\]]*)\]([*?]?)", notation):
        attributes, terms = [], []
        for word in body.replace(" & ", " ").split():
            name, eq, values = word.partition("=")
            if eq and not name.startswith(("^", "&")):
                attributes.append((name, ("^", *values[1:].split("|")) if values.startswith("^") else tuple(values.split("|"))))
            else:
                terms.append(word)
        out.append(Pattern(tuple(attributes), (tuple(terms),) if terms else (), repeat))
    return tuple(out)


def apply_sets(
    sentences: DataFrame, sets: Sequence[RuleSet], key: Sequence[str], kinds: Sequence[str] | None = None, functions: Mapping[str, Function] | None = None, tables: Tables = NO_TABLES
) -> DataFrame:
    """sentences (key, units array<struct<surface, lemma, pos, ...>>, strings all) to key and features array<array<string>>.

    kinds gives the order in which the kinds of sets run; without it they run as they stand. Sentences are rows, so they
    spread over all tasks; the rules go to the tasks once.
    """
    order = list(kinds or dict.fromkeys(s.kind for s in sets))
    from glossa.operators.predicates import FUNCTIONS

    known = functions if functions is not None else FUNCTIONS

    @F.arrow_udf("array<array<string>>")
    def run(column):
        import numpy as np
        import pyarrow as pa

        flat = column.flatten()
        names = [f.name for f in column.type.value_type]
        ends = np.r_[0, np.array(column.value_lengths().fill_null(0)).cumsum()]
        made, row = [], 0
        while row < len(column):  # as many sentences as have HELD units, one at least
            last = max(row + 1, int(np.searchsorted(ends, ends[row] + HELD, "right")) - 1)
            held = flat.slice(ends[row], ends[last] - ends[row])
            values = [["" if v is None else v if isinstance(v, str) else str(v) for v in held.field(i).to_pylist()] for i in range(len(names))]
            units = [Unit(dict(zip(names, v, strict=True))) for v in zip(*values, strict=True)]
            bounds = (ends[row : last + 1] - ends[row]).tolist()
            for at, end in zip(bounds[:-1], bounds[1:], strict=True):
                for kind in order if end > at else ():
                    dispatch(sets, kind, units[at:end], known, tables)
            inner = np.array([0, *(len(u.features) for u in units)], np.int32).cumsum(dtype=np.int32)
            made.append(pa.ListArray.from_arrays(pa.array(inner), pa.array([f for u in units for f in u.features], pa.string())))
            row = last
        features = pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.string()))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), features)

    return sentences.select(*key, run("units").alias("features"))


def apply_to_sentences(sentences: DataFrame, rules: Sequence[Rule], key: Sequence[str], by: str = "unit", leave: str = "none") -> DataFrame:
    """apply_sets with one set of rules."""
    return apply_sets(sentences, [RuleSet("rules", tuple(rules), by, leave)], key)


def choose_homographs(groups: DataFrame, rules: Sequence[Sequence[Pattern]], key: Sequence[str]) -> DataFrame:
    """groups (key, alternatives array<struct<surface, lemma, ...>>) to key, chosen (from 0) and others (their ALT- features)."""

    @F.pandas_udf("chosen int, others array<string>")
    def run(column: pd.Series) -> pd.DataFrame:
        found = [choose_homograph([Unit({k: "" if v is None else str(v) for k, v in dict(u).items()}) for u in row], rules) for row in column]
        return pd.DataFrame({"chosen": [f[0] for f in found], "others": [f[1] for f in found]}, columns=["chosen", "others"])

    made = groups.withColumn("_found", run("alternatives"))
    return made.select(*key, "alternatives", "_found.*")
