"""Basic units: the parts of phrases that later stages work on, one content morpheme with what belongs to it.

A unit starts with a phrase and wherever its own mark is; its morphemes are prefix, content or suffix. Everything is made from
the array of morphemes inside the sentence's row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators.structure import spans

Test = Callable[[Column], Column]
#: What a morpheme is, as bits of one number: every test is asked once a morpheme, and the rest reads numbers.
PHRASE, UNIT, PREFIX, CONTENT, SEMI = 1, 2, 4, 8, 16


def starts(ms: str, test: Test) -> Column:
    """The positions of an array column's morphemes where test holds, and 0."""
    return F.filter(F.sequence(F.lit(0), F.size(ms) - 1), lambda i: (i == 0) | test(F.get(ms, i)))


def unit_arrays(rows: DataFrame, keys: Sequence[str], ms: str, phrase: Test, unit: Test, prefix: Test, content: Test, semi: Test | None = None) -> DataFrame:
    """(keys, ms, us): the units of each sentence as structs (phrase_no, first, last, n_prefix, n_content, n_suffix, head).

    phrase and unit mark the morphemes that start one; prefix those before the content, content the content ones. The head is
    the last content or, with semi, semi-content morpheme, else the first. A sentence without morphemes has no row.
    """
    bits = [(phrase, PHRASE), (unit, UNIT), (prefix, PREFIX), (content, CONTENT)] + ([(semi, SEMI)] if semi is not None else [])
    tests = list(dict.fromkeys(t for t, _ in bits))  # one that serves twice is asked once

    def marks(m: Column) -> Column:
        asked = [F.when(t(m), F.lit(sum(b for other, b in bits if other is t))).otherwise(F.lit(0)) for t in tests]
        return reduce(lambda a, b: a + b, asked)

    def let(value: Column, use: Test) -> Column:
        return F.get(F.transform(F.array(value), use), 0)  # a lambda's argument is computed once

    has = lambda m, bit: m.bitwiseAND(F.lit(bit)) != 0
    base = rows.where(F.size(ms) > 0).select(*keys, ms, F.transform(ms, marks).alias("_ms"))
    begun = base.select(*keys, ms, "_ms", starts("_ms", lambda m: has(m, PHRASE)).alias("_ps"))
    phrases = begun.select(*keys, ms, "_ms", spans(F.col("_ps"), F.size("_ms")).alias("_spans"))

    def inside(span: Column, k: Column) -> Column:
        at = F.filter(F.sequence(span["first"], span["last"]), lambda i: (i == span["first"]) | has(F.get("_ms", i), UNIT))
        cut = lambda at: F.transform(at, lambda a, i: described(k, a, F.coalesce(F.get(at, i + 1), span["last"] + 1) - 1))
        return let(at, cut)

    def described(k: Column, first: Column, last: Column) -> Column:
        return let(F.slice("_ms", first + 1, last - first + 1), lambda own: told(k, first, own))

    def told(k: Column, first: Column, own: Column) -> Column:
        before = F.size(F.filter(own, lambda m: has(m, PREFIX)))
        heads = F.size(F.filter(own, lambda m: m.bitwiseAND(F.lit(PREFIX | CONTENT)) == CONTENT))
        head = F.array_max(F.transform(own, lambda m, i: F.when(has(m, CONTENT | SEMI), first + i)))
        rest = F.size(F.filter(own, lambda m: ~has(m, PREFIX | CONTENT)))
        return F.struct(
            k.alias("phrase_no"), first.alias("first"), (first + F.size(own) - 1).alias("last"), before.alias("n_prefix"), heads.alias("n_content"),
            rest.alias("n_suffix"), F.coalesce(head, first).alias("head"),
        )

    return phrases.select(*keys, ms, F.flatten(F.transform("_spans", inside)).alias("us"))


def units(rows: DataFrame, keys: Sequence[str], ms: str, phrase: Test, unit: Test, prefix: Test, content: Test, semi: Test | None = None) -> DataFrame:
    """unit_arrays with a row for each unit: (keys, unit_no, phrase_no, first, last, n_prefix, n_content, n_suffix, head)."""
    made = unit_arrays(rows, keys, ms, phrase, unit, prefix, content, semi)
    return made.select(*keys, F.posexplode_outer("us").alias("unit_no", "u")).select(*keys, "unit_no", "u.*")


def from_end(us: str) -> Column:
    """For each morpheme of a sentence its number from the end of its unit, from 0; us as in unit_arrays."""
    return F.flatten(F.transform(us, lambda u: F.transform(F.sequence(u["first"], u["last"]), lambda i: u["last"] - i)))


def given_units(records: DataFrame) -> DataFrame:
    """(sent_id, unit_no, phrase_no, first, last) of analysed records (sent_id, morphemes with phrase_no and bp_no) that come with
    their segmentation; morphemes that are alternatives of others are left out."""
    own = F.filter("morphemes", lambda m: m["alternative_of"].isNull())
    flat = records.select("sent_id", F.posexplode(own).alias("_at", "m"))
    return flat.groupBy("sent_id", F.col("m.bp_no").alias("unit_no"), F.col("m.phrase_no").alias("phrase_no")).agg(F.min("_at").alias("first"), F.max("_at").alias("last"))
