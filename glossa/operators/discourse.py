"""Mentions, antecedents and salience over an article's ordered sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mentions(rows: DataFrame, article: str, order: str, text: str = "text") -> DataFrame:
    """(article, order, entity, at): the capitalised words of each sentence once, lower-cased, with their first place."""
    found = rows.select(article, order, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"\p{Lu}\p{L}+"), F.lit(0))).alias("at", "word"))
    return found.groupBy(article, order, F.lower("word").alias("entity")).agg(F.min("at").alias("at"))


def nearest_antecedent(found: DataFrame, article: str, order: str, within: int) -> DataFrame:
    """found with `distance` to the nearest earlier sentence that has the entity, where that is near enough.

    An as-of join on equality is the previous row of its key, so one window does it without pairs.
    """
    before = F.lag(order).over(Window.partitionBy(article, "entity").orderBy(order))
    return found.withColumn("distance", (F.col(order) - before).cast("long")).where(F.col("distance") <= within)


def asof_antecedent(anaphors: DataFrame, antecedents: DataFrame, article: str, order: str, conditions: list[Column], within: int) -> DataFrame:
    """The nearest earlier antecedent of each anaphor by prioritised conditions (fuzzy equality).

    anaphors: article, order, a_id, columns a_*; antecedents: article, order, b_id, columns b_*. A condition may be
    any predicate on both. Nearer beats a better condition; equal distances go to the earlier condition, then to
    the later b_id. The pair join is bounded by the distance.
    """
    left = anaphors.withColumnsRenamed({article: "_a_article", order: "_a_order"})
    right = antecedents.withColumnsRenamed({article: "_b_article", order: "_b_order"})
    rank = None
    for i, c in enumerate(conditions):
        rank = F.when(c, F.lit(i)) if rank is None else rank.when(c, F.lit(i))
    pairs = (
        left.join(
            right,
            (F.col("_a_article") == F.col("_b_article"))
            & (F.col("_b_order") <= F.col("_a_order"))
            & (F.col("_a_order") - F.col("_b_order") <= within)
            & (F.col("b_id") < F.col("a_id")),
        )
        .withColumn("condition", rank)
        .where(F.col("condition").isNotNull())
        .withColumn("distance", F.col("_a_order") - F.col("_b_order"))
    )
    best = Window.partitionBy("_a_article", "a_id").orderBy("distance", "condition", F.desc("b_id"))
    return pairs.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select(F.col("_a_article").alias(article), "a_id", "b_id", "condition", "distance")


def appositive_links(units: DataFrame, key: list[str], order: str, mark: Column, kind: str = "kind") -> DataFrame:
    """(key, a, b): a unit that mark closes and the one right after it name the same, unless both have kinds and these differ."""
    w = Window.partitionBy(*key).orderBy(order)
    near = units.withColumns({"_mark": mark, "_b": F.lead(order).over(w), "_kind": F.lead(kind).over(w)})
    agree = F.col(kind).isNull() | F.col("_kind").isNull() | (F.col(kind) == F.col("_kind"))
    return near.where(F.col("_mark") & F.col("_b").isNotNull() & agree).select(*key, F.col(order).alias("a"), F.col("_b").alias("b"))


def title_links(units: DataFrame, key: list[str], order: str, title: Column, person: Column, word: str) -> DataFrame:
    """(key, order, name): units whose word is a title right after a person's name, with that name: they stand for the person, as
    the name itself does."""
    w = Window.partitionBy(*key).orderBy(order)
    near = units.withColumns({"_title": title, "_person": F.lag(person).over(w), "_name": F.lag(word).over(w)})
    return near.where(F.col("_title") & F.col("_person")).select(*key, order, F.col("_name").alias("name"))


def bridging_links(parts: DataFrame, wholes: DataFrame, relation: DataFrame, article: str, order: str, within: int) -> DataFrame:
    """(article, order, part, whole, whole_order): for each part (article, order, word) its nearest earlier whole (article, order, word), by
    relation (part, whole), at most `within` sentences back; equal distances go to the word that sorts first.

    For a word the last sentence that has it before each sentence is one running maximum, so parts meet words, not mentions.
    """
    asked = parts.select(article, order, F.col("word").alias("part")).distinct().join(relation.select("part", F.col("whole").alias("word")).distinct(), "part")
    told = wholes.select(article, order, "word", F.col(order).alias("_at"), F.lit(None).cast("string").alias("part")).distinct()
    both = asked.select(article, order, "word", F.lit(None).cast(dict(wholes.dtypes)[order]).alias("_at"), "part").unionByName(told)
    before = Window.partitionBy(article, "word").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("whole_order", F.max("_at").over(before)).where(F.col("part").isNotNull() & (F.col(order) - F.col("whole_order") <= within))
    best = Window.partitionBy(article, order, "part").orderBy(F.desc("whole_order"), "word")
    return found.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select(article, order, "part", F.col("word").alias("whole"), "whole_order")


def synonym_pairs(words: DataFrame, synonyms: DataFrame, word: str = "word") -> DataFrame:
    """(a, b): words that are synonyms once the prefix and the suffix that they share are taken off.

    synonyms (x, y) have no first and no last letter in common, so what is left of two words is a pair of theirs exactly when the
    words are p + x + s and p + y + s. Words are filed under (p, s, x) for each place where a synonym stands in them, and meet by
    equality; no two words are compared otherwise.
    """
    terms = synonyms.select(F.col("x").alias("term")).unionByName(synonyms.select(F.col("y").alias("term"))).distinct()
    own = words.select(F.col(word).alias("w")).distinct()
    n = F.char_length("w") - F.char_length("term") + 1
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.col("w").substr(i, F.char_length("term")) == F.col("term"))
    found = own.join(F.broadcast(terms), F.contains("w", "term")).select("w", "term", F.explode(at).alias("at"))  # a rule list, not data
    filed = found.select("w", "term", F.expr("substring(w, 1, at - 1)").alias("p"), F.expr("substring(w, at + char_length(term))").alias("s"))
    left, right = filed.select(F.col("w").alias("a"), F.col("term").alias("x"), "p", "s"), filed.select(F.col("w").alias("b"), F.col("term").alias("y"), "p", "s")
    return left.join(F.broadcast(synonyms), "x").join(right, ["y", "p", "s"]).select("a", "b").distinct()


def salience(weighted: DataFrame, article: str, order: str, entity: str, weight: str, base: float = 0.5, reach: int = 900) -> DataFrame:
    """weighted with `salience`, the sum of weights so far times base ** distance in sentences.

    With s the sum of weight / base ** order, a sentence's salience is s * base ** order, so a running sum replaces the
    self-join; orders are cut into blocks of `reach` sentences so that powers stay in range of a double, and what
    earlier blocks leave is below the smallest double that counts.
    """
    block = F.floor(F.col(order) / reach)
    inside = F.col(order) - block * reach
    run = Window.partitionBy(article, entity, "_block").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    own = weighted.withColumn("_block", block).withColumn("_at", inside).withColumn("_s", F.sum(F.col(weight) * F.pow(F.lit(1 / base), F.col("_at"))).over(run))
    ends = own.groupBy(article, entity, "_block").agg(F.max_by("_s", order).alias("_left"))
    carried = own.join(ends.withColumn("_block", F.col("_block") + 1), [article, entity, "_block"], "left")
    left = F.coalesce(F.col("_left") * F.pow(F.lit(base), F.lit(float(reach))), F.lit(0.0))
    return carried.withColumn("salience", (F.col("_s") + left) * F.pow(F.lit(base), F.col("_at"))).drop("_block", "_at", "_s", "_left")
