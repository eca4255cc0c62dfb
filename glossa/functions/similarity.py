"""Similarity of sets, codes and strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distributional(a: Column, b: Column, least_common: int = 3) -> Column:
    """Mean of Jaccard and Simpson of two context arrays; 0 where fewer than `least_common` are shared."""
    both = F.size(F.array_intersect(a, b))
    jaccard = both / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    simpson = both / F.greatest(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(1))
    return F.when(both < least_common, 0.0).otherwise((jaccard + simpson) / 2)


def code_similarity(a: Column, b: Column) -> Column:
    """Twice the common depth over the sum of depths, of two arrays that are paths from the root."""
    n = F.least(F.size(a), F.size(b))
    common = F.array_max(F.filter(F.sequence(F.lit(0), n), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))
    depth = F.size(a) + F.size(b)
    return F.when(depth == 0, 0.0).otherwise(2 * common / F.greatest(depth, F.lit(1)))


def best_code_similarity(a: Column, b: Column) -> Column:
    """The largest code_similarity between the paths of two arrays of paths, 0 where either has none."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: code_similarity(x, y))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def set_pairs(members: DataFrame, owner: str, element: str, least_common: int = 3) -> DataFrame:
    """(s1, s2, common, similarity) of every two owners that share enough elements: `distributional` without gathering a set.

    members (owner, element) may repeat. The sets meet by a join on the element, counted before anything else, so its output is
    pairs of owners for each element; owners are few (sources, languages), elements many.
    """
    rows = members.select(F.col(owner).alias("s"), F.col(element).alias("e")).distinct()
    size = rows.groupBy("s").agg(F.count("*").alias("n"))
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, (F.col("a.e") == F.col("b.e")) & (F.col("a.s") < F.col("b.s"))).groupBy(F.col("a.s").alias("s1"), F.col("b.s").alias("s2")).agg(F.count("*").alias("common"))
    sized = both.join(size.select(F.col("s").alias("s1"), F.col("n").alias("n1")), "s1").join(size.select(F.col("s").alias("s2"), F.col("n").alias("n2")), "s2")
    mean = (F.col("common") / (F.col("n1") + F.col("n2") - F.col("common")) + F.col("common") / F.least("n1", "n2")) / 2
    return sized.where(F.col("common") >= least_common).select("s1", "s2", "common", mean.alias("similarity"))


def with_table(pairs: DataFrame, table: DataFrame, computed: Column, threshold: float = 0.15) -> DataFrame:
    """pairs (w1, w2, ...) with `similarity`: from table (w1 < w2, sim) where it has the pair, below the threshold 0,
    else computed."""
    known = table.select(F.col("w1").alias("_a"), F.col("w2").alias("_b"), F.col("sim").alias("_sim"))
    at = (F.least("w1", "w2") == F.col("_a")) & (F.greatest("w1", "w2") == F.col("_b"))
    found = F.when(F.col("_sim") < threshold, 0.0).otherwise(F.col("_sim"))
    return pairs.join(known, at, "left").withColumn("similarity", F.coalesce(found, computed)).drop("_a", "_b", "_sim")
