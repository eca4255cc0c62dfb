"""Line dedup: range-partitioned line hashes, streamed in (hash, document, position) order.

A line's key is the line stripped of ASCII white space with A-Z lower-cased. A key of at least
`min_chars` code points that occurs in two or more documents stays in the smallest doc_id only. Lines
travel as 128-bit hashes; texts are never shuffled to find them, and the answer is a run-length keep
bitmap per document.

A key that holds more than `HOT_SHARE` of all lines (so at most 1 / HOT_SHARE keys) is found with a
mergeable frequent-items sketch and settled by a map-side combined minimum; every other key passes the
range partitioning. Both ways are exact, so the sketch only decides which way a key takes.

Defined cases: a null or empty text is one empty line. Rows without a doc_id keep all lines and drop no
others. Rows that share a doc_id count as one document. Repeated lines of the owner all stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import SPACES, ascii_lower, materialize

HOT_SHARE = 1e-4


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of every line whose key is long enough."""
    key = ascii_lower(F.btrim(F.col("line"), F.lit(SPACES)))
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )


def hot_hashes(occ: DataFrame) -> DataFrame:
    """h1 of the keys above HOT_SHARE of all lines: at most 1 / HOT_SHARE rows."""
    most = round(1 / HOT_SHARE)
    top = occ.agg(F.expr(f"approx_top_k(h1, {most}, {10 * most})").alias("top"), F.count("*").alias("total"))
    return (
        top.select("total", F.explode("top").alias("t"))
        .where(F.col("t.count") > F.col("total") * HOT_SHARE)
        .select(F.col("t.item").alias("h1"))
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, text_hash, dropped) for the documents that lose lines; dropped: array<struct<first, last>> of line
    positions from 0, in order, the run-length form of the keep bitmap's zeros."""
    occ = materialize(occurrences(docs, min_chars), "lines")
    hot = F.broadcast(materialize(hot_hashes(occ), "hot-lines"))
    owners = (
        occ.join(hot, "h1", "left_semi")
        .groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("owner"))
    )
    of_hot = (
        occ.join(F.broadcast(owners), ["h1", "h2"])
        .where(F.col("doc_id") > F.col("owner"))
        .select("doc_id", "text_hash", "pos")
    )
    stream = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    of_rest = (
        occ.join(hot, "h1", "left_anti")
        .repartitionByRange("h1", "h2")
        .withColumn("owner", F.first("doc_id").over(stream))
        .where(F.col("doc_id") > F.col("owner"))
        .select("doc_id", "text_hash", "pos")
    )
    at = F.col("at")
    return (
        of_hot.unionByName(of_rest)
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set("pos")).alias("at"))
        .select(
            "doc_id",
            "text_hash",
            F.arrays_zip(
                F.filter(at, lambda x, i: (i == 0) | (F.try_element_at(at, i) != x - 1)).alias("first"),
                F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.try_element_at(at, i + 2) != x + 1)).alias("last"),
            ).alias("dropped"),
        )
    )


def kept_lines(ls: Column, dropped: Column) -> Column:
    """The lines between the dropped runs."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda r: r["last"] + 1))
    ends = F.concat(F.transform(dropped, lambda r: r["first"]), F.array(F.size(ls)))
    gaps = F.arrays_zip(starts.alias("a"), ends.alias("z"))
    return F.flatten(F.transform(gaps, lambda g: F.slice(ls, g["a"] + 1, g["z"] - g["a"])))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, dropped (runs), kept (the text that stays)."""
    maps = keep_bitmaps(docs.select("doc_id", "text"), min_chars)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    ls = lines(F.col("text"))
    none = F.col("dropped").isNull()
    lost = F.aggregate("dropped", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return keyed.join(maps, ["doc_id", "text_hash"], "left").select(
        "doc_id",
        F.size(ls).cast("long").alias("n_lines"),
        F.when(none, F.lit(0).cast("long")).otherwise(lost).alias("n_dropped"),
        "dropped",
        F.when(none, F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept_lines(ls, F.col("dropped")), "\n")).alias("kept"),
    )
