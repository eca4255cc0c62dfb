"""Key-value tables: bulk load with a merge policy, bucketed by key, and look-up by join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bulk_load(rows: DataFrame, policy: str = "last", order: str | None = None, separator: str = "/") -> DataFrame:
    """(key, value) with one row per key. policy: append (strings joined in order), or / and (strings of 0 and 1, place by
    place), last or first by order."""
    by = rows.groupBy("key")
    place = F.col(order) if order else F.lit(0)
    if policy == "append":
        own = F.array_sort(F.collect_list(F.struct(place.alias("o"), F.col("value").alias("v"))))
        return by.agg(F.array_join(F.transform(own, lambda x: x["v"]), separator).alias("value"))
    if policy in ("or", "and"):
        n = F.length("value")
        bits = rows.select("key", F.posexplode(F.split("value", "")).alias("i", "b"), n.alias("n"))
        one = F.max("b") if policy == "or" else F.min("b")
        folded = bits.groupBy("key", "i").agg(one.alias("b"))
        own = F.array_sort(F.collect_list(F.struct("i", "b")))
        return folded.groupBy("key").agg(F.array_join(F.transform(own, lambda x: x["b"]), "").alias("value"))
    if policy in ("first", "last"):
        pick = F.min_by if policy == "first" else F.max_by
        return by.agg(pick("value", place).alias("value"))
    raise ValueError(policy)


def save(table: DataFrame, name: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by key, so that look-ups of many keys join without a shuffle of it."""
    table.write.bucketBy(buckets, "key").sortBy("key").mode("overwrite").saveAsTable(name)


def look_up(keys: DataFrame, table: DataFrame) -> DataFrame:
    return keys.join(table, "key", "left")
