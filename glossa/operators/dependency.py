"""Dependency candidates between the phrases of a sentence, and masks on them.

Candidates are pairs dependent < governor; no governor stands beyond the dependent's `reach`, its barrier. What can be
answered inside a sentence's row, from the array of its phrases, is a column: counts of candidates, the default head, links
by relaxation. Nothing is paired by a join and nothing is shuffled for these. Where pairs are wanted as rows, as for the masks
that join them with quotations and correlatives, phrases have a key, sent_no, phrase_no and what the rules read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sentence_window(key: str) -> Window:
    return Window.partitionBy(key, "sent_no").orderBy("phrase_no")


def with_barrier(phrases: DataFrame, barrier: Column, key: str = "doc_id") -> DataFrame:
    """phrases with `reach`, the first later phrase where the barrier holds, or else the last of the sentence."""
    ahead = sentence_window(key).rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(key, "sent_no")
    first = F.min(F.when(barrier, F.col("phrase_no"))).over(ahead)
    return phrases.withColumn("reach", F.coalesce(first, F.max("phrase_no").over(whole)))


def first_rule(phrases: DataFrame, rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule whose predicate holds; `default` where none does."""
    out = None
    for name, predicate in rules:
        out = F.when(predicate, F.lit(name)) if out is None else out.when(predicate, F.lit(name))
    return F.lit("default") if out is None else out.otherwise("default")


def candidates(phrases: DataFrame, governor_type: Column, key: str = "doc_id") -> DataFrame:
    """(key, sent_no, dependent, governor, type) for every pair up to the dependent's `reach` with a type.

    governor_type may read the dependent's columns and the governor's, the latter with the prefix g_.
    """
    right = phrases.select(*[F.col(c).alias(f"g_{c}") for c in phrases.columns])
    at = (
        (F.col(key) == F.col(f"g_{key}"))
        & (F.col("sent_no") == F.col("g_sent_no"))
        & (F.col("g_phrase_no") > F.col("phrase_no"))
        & (F.col("g_phrase_no") <= F.col("reach"))
    )
    pairs = phrases.join(right, at).withColumn("type", governor_type).where(F.col("type").isNotNull())
    return pairs.select(key, "sent_no", F.col("phrase_no").alias("dependent"), F.col("g_phrase_no").alias("governor"), "type")


Kind = Callable[[Column, Column], Column]


def _later(p: Column, i: Column) -> Column:
    """The positions after i up to the reach of phrase p."""
    return F.when(p["reach"] > i, F.sequence(i + 1, p["reach"])).otherwise(F.array().cast("array<int>"))


def count_candidates(ps: str, kind: Kind, types: Sequence[str]) -> Column:
    """array<struct<type, n, distance>> of a sentence: how many pairs have each type, and their distances' sum.

    ps names an array column of phrases with `reach`; kind gives the type of (dependent, governor), null for none.
    """
    zero = F.lit(0).cast("long")

    def own(codes: Column, t: str) -> Column:
        """(n, distance) of a phrase's pairs of a type; codes: the types by distance - 1."""
        far = F.filter(F.transform(codes, lambda x, k: F.when(x == t, k + 1)), lambda k: k.isNotNull())
        return F.get(F.transform(F.array(far), lambda d: F.struct(F.size(d).cast("long").alias("n"), F.aggregate(d, zero, lambda a, x: a + x).alias("distance"))), 0)

    def each(p: Column, i: Column) -> Column:  # a lambda's argument is computed once: each pair is typed once
        later = F.transform(F.slice(ps, i + 2, F.greatest(p["reach"] - i, F.lit(0))), lambda g: kind(p, g))
        return F.get(F.transform(F.array(later), lambda codes: F.array(*[own(codes, t) for t in types])), 0)

    def told(rows: Column) -> Column:
        total = lambda k, field: F.aggregate(rows, zero, lambda a, r: a + F.get(r, k)[field])
        return F.array(*[F.struct(F.lit(t).alias("type"), total(k, "n").alias("n"), total(k, "distance").alias("distance")) for k, t in enumerate(types)])

    return F.get(F.transform(F.array(F.transform(ps, each)), told), 0)


Test = Callable[[Column], Column]


def count_ruled(ps: str, rules: Sequence[tuple[str, Test, Test]]) -> Column:
    """count_candidates for types that a test of the governor and a test of the dependent decide together: (type, governor's,
    dependent's); one pair may have several. No pair is made: a phrase that governs has all dependents since the last barrier,
    whose number and sum of places are carried along, so the work grows with the phrases."""
    long = lambda x: F.lit(x).cast("long")
    names = [f"{field}{k}" for k in range(len(rules)) for field in "cwnd"]
    zero = F.struct(long(0).alias("i"), F.lit(-1).alias("reach"), *[long(0).alias(x) for x in names])

    def step(s: Column, p: Column) -> Column:
        fields, same = [], s["reach"] == p["reach"]
        for k, (_, governs, depends) in enumerate(rules):
            c, w, n, d = (s[f"{x}{k}"] for x in "cwnd")
            yes, own = governs(p), depends(p)
            fields += [
                (F.when(same, c).otherwise(0) + F.when(own, 1).otherwise(0)).alias(f"c{k}"), (F.when(same, w).otherwise(0) + F.when(own, s["i"]).otherwise(0)).alias(f"w{k}"),
                F.when(yes, n + c).otherwise(n).alias(f"n{k}"), F.when(yes, d + c * s["i"] - w).otherwise(d).alias(f"d{k}"),
            ]
        return F.struct((s["i"] + 1).alias("i"), p["reach"].alias("reach"), *fields)

    told = lambda s: F.array(*[F.struct(F.lit(t).alias("type"), s[f"n{k}"].alias("n"), s[f"d{k}"].alias("distance")) for k, (t, _, _) in enumerate(rules)])
    return F.aggregate(ps, zero, step, told)


#: How many later phrases are tried first for a near governor.
NEAR = 16


def default_governors(ps: str, kind: Kind, preference: int) -> Column:
    """The preference-th nearest governor of each phrase of a sentence, the farthest for -1 or where there are fewer, null where
    there is none; ps and kind as in count_candidates. The nearest phrases are tried first, all of them only where these aren't
    enough."""

    def one(p: Column, i: Column) -> Column:
        of = lambda places: F.filter(places, lambda j: kind(p, F.get(ps, j)).isNotNull())
        every = F.transform(F.array(of(_later(p, i))), lambda js: F.get(js, (F.size(js) if preference == -1 else F.least(F.lit(preference), F.size(js))) - 1))
        if preference == -1:
            return F.get(every, 0)
        near = of(F.slice(_later(p, i), 1, NEAR))
        return F.coalesce(F.get(near, preference - 1), F.get(every, 0))

    return F.transform(ps, one)


def relaxed_governors(ps: str, kind: Kind, closes: Callable[[Column], Column]) -> Column:
    """The governor, by relaxation, of each phrase without a candidate: its last possible position, the reach, if that ends the
    sentence or if `closes` holds there (the end of an inner sentence, a closing bracket); else null."""

    def one(p: Column, i: Column) -> Column:
        none = ~F.exists(_later(p, i), lambda j: kind(p, F.get(ps, j)).isNotNull())
        ends = (p["reach"] == F.size(ps) - 1) | closes(F.get(ps, p["reach"]))
        return F.when((p["reach"] > i) & none & ends, p["reach"])

    return F.transform(ps, one)


def links(rows: DataFrame, governors: Column, keys: Sequence[str]) -> DataFrame:
    """(keys, dependent, governor) of an array of governors by dependent."""
    return rows.select(*keys, F.posexplode_outer(governors).alias("dependent", "governor")).where("governor IS NOT NULL")


def mask_quotes(pairs: DataFrame, quotes: DataFrame, key: str = "doc_id") -> DataFrame:
    """pairs but for those that cross a quotation (key, sent_no, first, last): from before it into it but for its last
    phrase, or from inside it past its end."""
    q = quotes.select(F.col(key).alias("_key"), F.col("sent_no").alias("_sent"), "first", "last").where("first < last")
    into = (F.col("dependent") < F.col("first")) & (F.col("governor") >= F.col("first")) & (F.col("governor") < F.col("last"))
    past = (F.col("dependent") >= F.col("first")) & (F.col("dependent") < F.col("last")) & (F.col("governor") > F.col("last"))
    return pairs.join(q, (F.col(key) == F.col("_key")) & (F.col("sent_no") == F.col("_sent")) & (into | past), "left_anti")


def pair_quotes(phrases: DataFrame, opens: Column, closes: Column, key: str = "doc_id") -> DataFrame:
    """(key, sent_no, first, last) of each bracket pair by phrase; an unmatched opening one ends with the sentence, an
    unmatched closing one begins at phrase 0. opens and closes count the brackets of a phrase."""


    marks = F.concat(F.array_repeat(F.struct(F.lit(1).alias("d"), F.col("phrase_no").alias("p")), opens), F.array_repeat(F.struct(F.lit(-1).alias("d"), F.col("phrase_no").alias("p")), closes))
    rows = phrases.select(key, "sent_no", "phrase_no", marks.alias("marks"))
    per = rows.groupBy(key, "sent_no").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("phrase_no", "marks"))), lambda x: x["marks"])).alias("marks"), F.max("phrase_no").alias("end")
    )
    zero = F.struct(F.array().cast("array<int>").alias("stack"), F.array().cast("array<struct<first:int,last:int>>").alias("found"))

    def step(s: Column, m: Column) -> Column:
        empty = F.size(s["stack"]) == 0
        first = F.when(empty, 0).otherwise(F.try_element_at(s["stack"], F.lit(-1)))
        closed = F.array_append(s["found"], F.struct(first.cast("int").alias("first"), m["p"].alias("last")))
        popped = F.when(empty, s["stack"]).otherwise(F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0))))
        return F.when(m["d"] == 1, F.struct(F.array_append(s["stack"], m["p"]).alias("stack"), s["found"].alias("found"))).otherwise(
            F.struct(popped.alias("stack"), closed.alias("found"))
        )

    done = per.withColumn("s", F.aggregate("marks", zero, step))
    left = F.transform("s.stack", lambda p: F.struct(p.alias("first"), F.col("end").alias("last")))
    return done.select(key, "sent_no", F.explode(F.concat("s.found", left)).alias("q")).select(key, "sent_no", "q.first", "q.last")


def correlatives(units: DataFrame, start: Column, end: Column, order: str, key: list[str]) -> DataFrame:
    """(key, start, end): each start with the nearest later end, as a window minimum and not a pair join."""
    ahead = Window.partitionBy(*key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    found = units.withColumn("_start", start).withColumn("_end", F.min(F.when(end, F.col(order))).over(ahead))
    return found.where(F.col("_start") & F.col("_end").isNotNull()).select(*key, F.col(order).alias("start"), F.col("_end").alias("end"))


def mask_correlatives(pairs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """A start keeps its end as head alone; phrases inside keep heads up to the end; those before don't reach inside."""
    c = found.select(F.col(key).alias("_key"), F.col("sent_no").alias("_sent"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    bad = (
        ((F.col("dependent") == F.col("_s")) & (F.col("governor") != F.col("_e")))
        | ((F.col("dependent") > F.col("_s")) & (F.col("dependent") < F.col("_e")) & (F.col("governor") > F.col("_e")))
        | ((F.col("dependent") < F.col("_s")) & (F.col("governor") > F.col("_s")) & (F.col("governor") < F.col("_e")))
    )
    return pairs.join(c, (F.col(key) == F.col("_key")) & (F.col("sent_no") == F.col("_sent")) & bad, "left_anti")


#: Relations of two spans, in the order in which they are tried.
ALLEN = ("before", "meets", "equal", "starts", "ends", "contains", "inside", "overlaps", "after")


def interval_relation(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return (
        F.when(a2 < b1, "before").when(a2 == b1, "meets").when((a1 == b1) & (a2 == b2), "equal").when(a1 == b1, "starts").when(a2 == b2, "ends")
        .when((a1 < b1) & (a2 > b2), "contains").when((a1 > b1) & (a2 < b2), "inside").when((a1 < b1) & (a2 < b2), "overlaps").otherwise("after")
    )


def is_projective(heads: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sent_no, projective): whether no two links cross; from dependents in order and their heads."""
    per = heads.groupBy(key, "sent_no").agg(F.array_sort(F.collect_list(F.struct("dependent", "governor"))).alias("links"))
    zero = F.struct(F.array().cast("array<int>").alias("open"), F.lit(True).alias("ok"))

    def step(s: Column, link: Column) -> Column:
        live = F.filter(s["open"], lambda g: g > link["dependent"])
        fits = F.forall(live, lambda g: link["governor"] <= g)
        return F.struct(F.array_append(live, link["governor"]).alias("open"), (s["ok"] & fits).alias("ok"))

    return per.select(key, "sent_no", F.aggregate("links", zero, step)["ok"].alias("projective"))
