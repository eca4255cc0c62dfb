"""Canonical forms, predicate keys, voice, case particles and inflection, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.features import has, value

#: Surface cases in slot order, with their particles.
CASES = {"ga": "が", "wo": "を", "ni": "に", "he": "へ", "to": "と", "kara": "から", "yori": "より", "made": "まで", "de": "で", "no": "の", "ga2": "が２"}
#: Voice flags, by the value that the voice feature holds.
VOICES = {"passive": 1, "causative": 2, "benefactive": 4, "desiderative": 8}


def canonical(lemma: Column, reading: Column) -> Column:
    return F.concat_ws("/", lemma, reading)


def joined_canonical(forms: Column) -> Column:
    """The canonical form of a unit from those of its parts; parts without one are left out."""
    return F.array_join(F.filter(forms, lambda f: f.isNotNull() & (f != "")), "+")


def voice_flags(features: Column, name: str = "voice") -> Column:
    """The bits of the voices in a feature such as voice:passive&causative."""
    parts = F.split(F.coalesce(value(features, name), F.lit("")), "&")
    flags = [F.when(F.array_contains(parts, v), F.lit(bit)).otherwise(0) for v, bit in VOICES.items()]
    out = flags[0]
    for f in flags[1:]:
        out = out + f
    return out


def predicate_key(form: Column, kind: Column, features: Column) -> Column:
    """canonical form, type and voices, as frames are keyed; a copula's noun and a negation are marked."""
    noun = F.when(has(features, "copula"), F.lit("+copula")).otherwise("")
    negated = F.when(has(features, "negation"), F.lit("+not")).otherwise("")
    voice = voice_flags(features)
    return F.concat(form, noun, negated, F.lit(":"), kind, F.when(voice > 0, F.concat(F.lit(":"), voice.cast("string"))).otherwise(""))


def case_code(name: Column) -> Column:
    """Slot number of a case, from 0, by its name or its particle; null for others."""
    at = F.create_map(*[x for i, (k, v) in enumerate(CASES.items()) for x in (F.lit(k), F.lit(i), F.lit(v), F.lit(i))])
    return F.try_element_at(at, name)


def case_name(code: Column) -> Column:
    return F.get(F.array(*map(F.lit, CASES)), code)


def case_vector(names: Column) -> Column:
    """0-1 array of the slots that an array of cases fills; unknown cases fill none."""
    codes = F.transform(names, case_code)
    return F.transform(F.sequence(F.lit(0), F.lit(len(CASES) - 1)), lambda i: F.exists(codes, lambda c: c.eqNullSafe(i)).cast("int"))


def or_vectors(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def and_vectors(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def compound_particle(text: Column) -> Column:
    """A compound particle without politeness and auxiliary endings: nitaishite and nitaisuru are one case."""
    plain = F.regexp_replace(text, "(?:まして|ます|ました)$", "て")
    return F.regexp_replace(plain, "(?:しての|した|する|して|し)$", "する")


def inflected(rows: DataFrame, endings: DataFrame, form: str) -> DataFrame:
    """rows (word, kind, ...) in base form with `inflected`, by a join with endings (kind, form, ending); null where the
    kind has no such form or the word hasn't the base ending."""
    base = endings.where(F.col("form") == "base").select("kind", F.col("ending").alias("_base"))
    want = endings.where(F.col("form") == form).select("kind", F.col("ending").alias("_want"))
    stem = F.when(F.col("word").endswith(F.col("_base")), F.expr("substring(word, 1, char_length(word) - char_length(_base))"))
    return rows.join(base, "kind", "left").join(want, "kind", "left").withColumn("inflected", F.concat(stem, "_want")).drop("_base", "_want")


def longest_suffix(rows: DataFrame, table: DataFrame, words: str, out: str) -> DataFrame:
    """rows with `out`, the value of the longest suffix of an array of words, joined, that table (key, value) has.

    Leading words are dropped until a key is found; all suffixes are one join, the longest is kept by a window.
    """
    numbered = rows.withColumn("_row", F.xxhash64(*rows.columns))
    keys = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.greatest(F.size(words), F.lit(1))), ""))
    suffixes = numbered.select("_row", F.posexplode(keys).alias("_dropped", "key")).distinct()
    found = suffixes.join(table.select("key", F.col("value").alias(out)), "key")
    best = found.withColumn("_rank", F.row_number().over(Window.partitionBy("_row").orderBy("_dropped", out))).where("_rank = 1").select("_row", out)
    return numbered.join(best, "_row", "left").drop("_row")


def lift(p_both: Column, p_a: Column, p_b: Column) -> Column:
    """How much likelier two events are together than apart; null where either never occurs."""
    return F.when((p_a > 0) & (p_b > 0), p_both / (p_a * p_b))


def margin_probability(margin: Column, slope: float = 10.0) -> Column:
    """A classifier's margin as a probability."""
    return 1 / (1 + F.exp(-slope * margin))


def binned(similarity: Column, bins: int = 10) -> Column:
    """The bin, from 0, of a similarity in 0 to 1; 1 is in the last."""
    return F.least(F.floor(similarity * bins), F.lit(bins - 1)).cast("int")
