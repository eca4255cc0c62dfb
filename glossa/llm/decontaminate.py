"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

A document is contaminated by an item when it holds at least `threshold` of the item's distinct word shingles.
Long documents and short items have a tiny Jaccard similarity, so the search is for containment: an item's
sketch is its bottom-m MinHash values, and m follows from the size partition (powers of two) of the item. With
u the largest size of the partition, m = u - ceil(threshold u) + 1, which is more than an item can miss, so one
sketch value at least is in every document that holds the item: no pair is lost. Sketch hits only propose
documents; these are then counted on the shingles themselves, as strings.

Items are sent to all tasks while their shingles are `broadcast_rows` at most; beyond that the joins shuffle.

Defined cases: words are lower-cased (A-Z) and split at ASCII white space. An item of fewer than `width` words
is one shingle, its whole word sequence. Items and documents without words never match. Repeated rows match
each. Rows that share a doc_id but not a text are told apart by a text hash. `clean` returns all columns of docs as
they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import hinted, materialize, words


def _slices(ws: Column, width: int, of) -> Column:
    n = F.size(ws) - (width - 1)
    return F.when(n < 1, F.array()).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: of(F.slice(ws, i, width))))


def shingle_hashes(ws: Column, width: int) -> Column:
    return F.array_distinct(_slices(ws, width, lambda s: F.xxhash64(s)))


def shingle_texts(ws: Column, width: int) -> Column:
    return F.array_distinct(_slices(ws, width, lambda s: F.array_join(s, " ")))


def item_shingles(items: DataFrame, width: int) -> DataFrame:
    """(item_id, width, n_shingles, shingle, hash) of all items."""
    ws = items.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    own = ws.withColumn("width", F.least(F.size("ws"), F.lit(width)))
    cut = F.when(F.size("ws") < width, F.array(F.array_join("ws", " "))).otherwise(shingle_texts(F.col("ws"), width))
    key = F.xxhash64(F.split("shingle", " ", -1))
    return (
        own.select("item_id", "width", cut.alias("all"))
        .select("item_id", "width", F.size("all").cast("long").alias("n_shingles"), F.explode("all").alias("shingle"))
        .distinct()
        .withColumn("hash", key)
    )


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """(width, hash): the bottom-m values of each item, m by its size partition."""
    top = F.pow(F.lit(2.0), F.floor(F.log2("n_shingles")) + 1) - 1
    m = (top - F.ceil(F.lit(threshold) * top) + 1).cast("int")
    return (
        shingles.groupBy("item_id", "width", "n_shingles")
        .agg(F.sort_array(F.collect_list("hash")).alias("hashes"))
        .select("width", F.explode(F.slice("hashes", F.lit(1), m)).alias("hash"))
        .distinct()
    )


def contaminated(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, broadcast_rows: int = 200_000
) -> DataFrame:
    """doc_id, text_hash, item_id, n_shingles, n_found, containment for every pair at or above the threshold."""
    shingles = materialize(item_shingles(items, width), "items")
    small = shingles.count() <= broadcast_rows
    hint = F.broadcast if small else (lambda df: df)
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    empty = docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, n_shingles long, n_found long, containment double")
    if not widths:
        return empty

    def exploded(df: DataFrame, make, name: str) -> DataFrame:
        ws = df.select("doc_id", "text_hash", words(F.col("text")).alias("ws"))
        tagged = lambda w: F.transform(make(F.col("ws"), w), lambda x: F.struct(F.lit(w).alias("width"), x.alias(name)))
        pairs = [tagged(w) for w in widths]
        return ws.select("doc_id", "text_hash", F.explode(F.concat(*pairs) if len(pairs) > 1 else pairs[0]).alias("s")).select(
            "doc_id", "text_hash", "s.width", f"s.{name}"
        )

    hits = exploded(keyed, shingle_hashes, "hash").join(hint(sketches(shingles, threshold)), ["width", "hash"], "left_semi")
    found = materialize(hits.select("doc_id", "text_hash").distinct(), "suspects")
    same = keyed["text_hash"].eqNullSafe(found["text_hash"]) & keyed["doc_id"].eqNullSafe(found["doc_id"])
    suspects = keyed.join(hinted(found), same, "left_semi").distinct()
    exact = exploded(suspects, shingle_texts, "shingle").join(hint(shingles.drop("hash")), ["width", "shingle"])
    return (
        exact.groupBy("doc_id", "text_hash", "item_id", "n_shingles")
        .agg(F.count("*").alias("n_found"))
        .withColumn("containment", F.col("n_found") / F.col("n_shingles"))
        .where(F.col("n_found") >= F.ceil(F.col("n_shingles") * F.lit(threshold) - 1e-9))
    )


def clean(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    bad = contaminated(docs, items, width, threshold).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    bad = materialize(bad, "contaminated")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    at = rows["_id"].eqNullSafe(bad["_id"]) & rows["_hash"].eqNullSafe(bad["_hash"])
    return rows.join(hinted(bad), at, "left_anti").select("row.*")
