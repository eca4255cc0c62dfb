"""Sharding: weighted rendezvous hashing of stable record keys.

Every record scores each shard with -ln(u) / weight, u a uniform hash of (key, shard), and goes to the
smallest. A shard that is added only takes records that now score best on it, so nothing moves between
old shards.

Slots number the records of a shard without gaps. They are counted in two levels, so that no task holds a
whole shard: records are numbered once, in a table of their own, and dealt by that number into sub-buckets
of about `bucket_rows`, so a key that many records share is no hot spot; bucket counts are prefix-summed and sent
back, and a window numbers each bucket.

Defined cases: the key is doc_id, or a hash of the text where doc_id is null. Repeated rows share a shard
and get slots of their own. A null text counts as no bytes and CRC 0. `sharded` keeps all columns of docs under their
names; a column that it adds takes an underscore at its end for each time that its name, whatever the case, is there.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import free_name, hinted, materialize, unit_hash

ADDED = ("size", "text_crc32", "shard", "slot", "grown_shard")


def draw(key: Column, shard: int, weight: float) -> Column:
    return -F.log(unit_hash(F.lit(shard), key)) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """(draw, shard): the smallest weighted draw and its shard, from 0."""
    draws = [F.struct(draw(key, i, w).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.least(*draws) if len(draws) > 1 else draws[0]


def _numbered(docs: DataFrame, shards: int, weights: Sequence[float] | None, bucket_rows: int, carry: bool) -> DataFrame:
    weights = list(weights or [1.0] * shards)
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    own = docs.select(
        *[F.struct("*").alias("row")] * carry,
        F.col("doc_id").alias("doc_id"),
        key.alias("key"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("best"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    grown = F.when(draw(F.col("key"), len(weights), 1.0) < F.col("best.draw"), F.lit(len(weights))).otherwise(F.col("best.shard"))
    sized = materialize(own.withColumns({"shard": F.col("best.shard").cast("int"), "grown_shard": grown.cast("int")}).drop("best", "key"), "shards")
    subs = max(64, ceil(sized.count() / len(weights) / bucket_rows))
    sized = sized.withColumn("sub", F.pmod(F.xxhash64(F.lit("slot"), "row_no"), F.lit(subs)).cast("int"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = sized.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    offsets = materialize(counts.select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    inside = Window.partitionBy("shard", "sub").orderBy("row_no")
    rank = sized.withColumn("rank", F.row_number().over(inside))
    return rank.join(hinted(offsets), ["shard", "sub"]).withColumn("slot", (F.col("offset") + F.col("rank") - 1).cast("long"))


def shard(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None, bucket_rows: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (of one more shard of weight 1) for every row of docs."""
    return _numbered(docs, shards, weights, bucket_rows, False).select("doc_id", *ADDED)


def sharded(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None, bucket_rows: int = 100_000) -> DataFrame:
    """The rows of docs, all columns, with the columns of shard."""
    names = {c: free_name(c, docs.columns) for c in ADDED}
    rows = _numbered(docs, shards, weights, bucket_rows, True)
    return rows.select("row", F.struct(*(F.col(c).alias(n) for c, n in names.items())).alias("added")).select("row.*", "added.*")
