"""Feature algebra on array<string> columns, and feature patterns compiled to predicates.

A feature is `name` or `name:value`. A pattern term matches a feature that equals it or starts with it and a
colon. Lists keep their order; the first match counts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term, with ^ for not; or a term that names a function of the row, as in "&name:argument".
Term = str
Predicate = Callable[[str], Column]


def name_of(feature: Column) -> Column:
    """The text before the first colon that isn't inside double quotes."""
    return F.regexp_extract(feature, r'^((?:[^":]|"[^"]*")*)', 1)


def matches(feature: Column, term: str) -> Column:
    return (feature == term) | feature.startswith(term + ":")


def has(features: Column, term: str) -> Column:
    return F.exists(features, lambda f: matches(f, term))


def value(features: Column, term: str) -> Column:
    """The value of the first feature named term; null where there is none."""
    return F.try_element_at(F.filter(features, lambda f: matches(f, term)), F.lit(1)).substr(F.lit(len(term) + 2), F.lit(1 << 30))


def put(features: Column, feature: str | Column) -> Column:
    """Overwrite the first feature of the same name in place, else append."""
    new = F.lit(feature) if isinstance(feature, str) else feature
    at = F.array_position(F.transform(features, name_of), name_of(new))
    return F.when(at > 0, F.transform(features, lambda f, i: F.when(i + 1 == at, new).otherwise(f))).otherwise(F.array_append(features, new))


def drop(features: Column, term: str) -> Column:
    return F.filter(features, lambda f: ~matches(f, term))


def drop_temporary(features: Column, prefix: str = "T-") -> Column:
    return F.filter(features, lambda f: ~f.startswith(prefix))


def without_last_field(feature: Column) -> Column:
    return F.regexp_replace(feature, ":[^:]*$", "")


def dnf(features: Column, pattern: Sequence[Sequence[Term]], functions: Mapping[str, Predicate] | None = None) -> Column:
    """OR of ANDs of terms; an empty pattern matches everything."""

    def one(term: Term) -> Column:
        negated, bare = term.startswith("^"), term.removeprefix("^")
        if bare.startswith("&"):
            name, _, argument = bare[1:].partition(":")
            found = (functions or {})[name](argument)
        else:
            found = has(features, bare)
        return ~found if negated else found

    if not pattern:
        return F.lit(True)
    return reduce(Column.__or__, (reduce(Column.__and__, map(one, terms), F.lit(True)) for terms in pattern))
