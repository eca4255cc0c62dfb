"""S-expressions, and lexicon, connection and rule files that are written in them."""

from __future__ import annotations

import re
from collections.abc import Iterator

TOKEN = re.compile(r';[^\n]*|\s+|([()])|"((?:[^"\\]|\\.)*)"|([^\s()";]+)')

Tree = str | list


def read(text: str) -> Iterator[Tree]:
    """The expressions of a text; a bracket too few or too many is an error."""
    stack: list[list] = [[]]
    for m in TOKEN.finditer(text):
        bracket, quoted, atom = m.groups()
        if bracket == "(":
            stack.append([])
        elif bracket == ")":
            if len(stack) == 1:
                raise ValueError(f"unopened bracket at {m.start()}")
            done = stack.pop()
            stack[-1].append(done)
        elif quoted is not None:
            stack[-1].append(re.sub(r"\\(.)", r"\1", quoted))
        elif atom is not None:
            stack[-1].append(atom)
        if len(stack) == 1 and stack[0]:
            yield stack[0].pop()
    if len(stack) > 1:
        raise ValueError("unclosed bracket")


def write(tree: Tree) -> str:
    if isinstance(tree, list):
        return "(" + " ".join(map(write, tree)) + ")"
    return tree if tree and not re.search(r'[\s()";]', tree) else '"' + re.sub(r'(["\\])', r"\\\1", tree) + '"'


def assoc(tree: list, name: str) -> list | None:
    """The first sublist that begins with name."""
    return next((x for x in tree if isinstance(x, list) and x and x[0] == name), None)


def lexicon(text: str) -> list[dict]:
    """Rows from (pos (subpos ((surface a b) (reading r) (kind k) (weight w) (left n) (right n) (sem "s")))) entries."""
    out = []
    for pos, *rest in read(text):
        for subpos, *entries in (rest if rest and isinstance(rest[0][0], str) else [["*", *rest]]):
            for e in entries:
                get = lambda name, e=e: (assoc(e, name) or [None])[1:]
                for surface in get("surface"):
                    row = {"surface": surface, "pos": pos, "subpos": subpos, "reading": (get("reading") or [surface])[0]}
                    row |= {n: float(v[0]) if n == "weight" else int(v[0]) for n in ("weight", "left", "right") if (v := get(n))}
                    row |= {n: v[0] for n in ("kind", "sem") if (v := get(n))}
                    out.append(row)
    return out


def connections(text: str) -> list[tuple[list[int], list[int], float]]:
    """Rules from ((left ids) (right ids) cost) entries."""
    return [([int(x) for x in left], [int(x) for x in right], float(cost)) for left, right, cost in read(text)]


def _part(x: Tree):
    """A pattern from its notation, several joined; ? stands for None."""
    from glossa.operators.rules import parse_pattern

    return None if x == "?" else parse_pattern(" ".join(x) if isinstance(x, list) else x)


def rules(text: str):
    """General rules from ((left) (self) (right) (actions)) entries of pattern notations and actions."""
    from glossa.operators.rules import Rule

    return [Rule(tuple(actions), _part(own), _part(left), _part(right)) for left, own, right, actions in read(text)]


def morpheme_rules(text: str, by: str = "unit", leave: str = "none"):
    """A rule set of morphemes from the same entries."""
    from glossa.operators.rules import RuleSet

    return RuleSet("morpheme", tuple(rules(text)), by, leave)


def phrase_rules(text: str, by: str = "unit", leave: str = "none", backwards: bool = False):
    """A rule set of phrases: each place of a pattern is a pattern on the phrase's own morphemes, in brackets of its own."""
    from glossa.operators.rules import Pattern, Rule, RuleSet

    def place(x: Tree):
        if x == "?":
            return None
        return tuple(Pattern(parts=_part(y)) if not isinstance(y, str) or not y.startswith("<") else Pattern(features=((y[1:-1],),)) for y in (x if isinstance(x, list) else [x]))

    found = [Rule(tuple(actions), place(own), place(left), place(right)) for left, own, right, actions in read(text)]
    return RuleSet("phrase", tuple(found), by, leave, backwards)


def homograph_rules(text: str):
    """Rules of alternatives from (pattern pattern ...) entries, the first preferred."""
    return [tuple(p for x in entry for p in _part(x)) for entry in read(text)]


def dependency_rules(text: str) -> list[dict]:
    """Rows (dependent, governors, barrier, preference) from ((dependent) ((governor type) ...) (barrier) preference) entries.

    Patterns stay notations, of one place each; governors are pairs of notation and type, a missing barrier is None, the
    preference is -1 for the farthest governor.
    """
    one = lambda x: " ".join(x) if isinstance(x, list) else x
    return [
        {"dependent": one(own), "governors": [(one(g[:-1]), g[-1]) for g in governors], "barrier": one(barrier) if barrier not in ("?", []) else None, "preference": int(preference)}
        for own, governors, barrier, preference in read(text)
    ]


def correlation_rules(text: str) -> list[dict]:
    """Rows (start, end, governor) from ((start) (end) [(governor)]) entries of notations."""
    one = lambda x: " ".join(x) if isinstance(x, list) else x
    return [{"start": one(e[0]), "end": one(e[1]), "governor": one(e[2]) if len(e) > 2 else None} for e in read(text)]
