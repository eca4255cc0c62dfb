"""Mixing sources to target weights: Efraimidis-Spirakis sampling into token budgets.

Targets share the words of all documents by source weight; a target stops at `max_epochs` times its
source's words and the excess is shared again among the others. A source gives floor(target / words)
complete epochs; the rest of its budget is filled in the order of exponential keys, -ln(u) / quality
weight, by a prefix sum of sizes. The document that crosses the budget is taken if that comes nearer.

What is taken of a source is all rows up to one cut in (key, row number), so only the cut is looked for: sizes are
summed in BINS bins of the key, prefix-summed, and the bin that the budget ends in is cut into bins again, until it has
few rows. Rows of equal keys, such as repeated documents, are then cut by row number. No source is one task, whatever
its share or its weights, and each row is decided where it lies: texts are never shuffled.

Defined cases: a null source is a source, ordered last. A null or blank text has size 0 and gives 0 words.
Repeated rows are documents of their own with equal keys. An empty table gives an empty result. Columns of docs other
than doc_id, text and source may have any names and types that Parquet holds; `mixed` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import WORD, hinted, materialize, unit_hash

BINS, FEW = 1024, 10_000


def quality_weight(text: Column) -> Column:
    """Share of letters among the characters that aren't ASCII white space, 0.05 to 1."""
    dense = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}+", ""))
    return F.greatest(F.lit(0.05), F.when(dense == 0, 0.05).otherwise(letters / dense))


def targets(sized: DataFrame, weights: list[int], max_epochs: int) -> DataFrame:
    """(source, source_size, target): water filling in closed form over the sources sorted by cap / weight."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sources.select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).alias("weight"),
        (F.col("source_size") * max_epochs).alias("cap"),
    )
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    used = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = weighted.withColumn("level", (total - used) / open_weight)
    free = F.col("level") * F.col("weight") < F.col("cap")
    return level.select(
        "source",
        "source_size",
        F.when(free, F.col("weight") * F.max(F.when(free, F.col("level"))).over(Window.partitionBy()))
        .otherwise(F.col("cap"))
        .cast("double")
        .alias("target"),
    )


def _open_rows(rows: DataFrame, state: DataFrame, value: Column) -> DataFrame:
    """The rows (source, ...) that lie in the open range [low, high] of their source, with the columns of state."""
    at = rows["source"].eqNullSafe(state["s"])
    return rows.withColumn("value", value.cast("double")).join(hinted(state), at).where(F.col("value").between(F.col("low"), F.col("high")))


def _narrow(rows: DataFrame, state: DataFrame, value: Column) -> DataFrame:
    """state (s, rest, before, low, high, n) with its range narrowed to the bin in which the sum of sizes passes rest."""
    wide = (F.col("n") > FEW) & (F.col("low") < F.col("high"))
    while not state.where(wide).isEmpty():
        bin_no = F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        sums = (
            _open_rows(rows, state.where(wide), value)
            .groupBy("s", "rest", "before", bin_no.alias("bin"))
            .agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        )
        run = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        through = sums.withColumn("through", F.col("before") + F.sum("size").over(run))
        found = through.where((F.col("through") > F.col("rest")) & (F.col("through") - F.col("size") <= F.col("rest")) & (F.col("size") > 0))
        found = found.select("s", "rest", (F.col("through") - F.col("size")).alias("before"), "low", "high", "n")
        state = materialize(found.unionByName(state.where(~wide)), "cuts")
    return state


def cuts(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """(s, cut_key, cut_no): the last row (key, row_no) that each source takes beside its complete epochs; budget has (source, rest)."""
    ranges = rows.groupBy("source").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"), F.sum("size").alias("all"))
    start = ranges.withColumnRenamed("source", "s").join(budget.select("source", "rest"), F.col("s").eqNullSafe(F.col("source")))
    start = materialize(start.where("rest > 0").select("s", "rest", F.lit(0).cast("long").alias("before"), "low", "high", "n", "all"), "cuts")
    whole = start.where("all <= rest").select("s", F.lit(float("inf")).alias("cut_key"), F.lit(0).cast("long").alias("cut_no"))
    by_key = _narrow(rows, start.where("all > rest").drop("all"), F.col("key"))
    few = F.col("n") <= FEW
    tied = by_key.where(~few).select("s", F.col("low").alias("tie"))
    equal = rows.join(hinted(materialize(tied, "ties")), rows["source"].eqNullSafe(F.col("s")) & (F.col("key") == F.col("tie"))).drop("s", "tie")
    numbers = equal.groupBy("source").agg(F.min("row_no").cast("double").alias("low"), F.max("row_no").cast("double").alias("high"))
    open_ties = by_key.where(~few).drop("low", "high").join(numbers, F.col("s").eqNullSafe(F.col("source"))).select("s", "rest", "before", "low", "high", "n")
    by_number = _narrow(equal, materialize(open_ties, "cuts"), F.col("row_no"))
    cols = ["s", "rest", "before", "size", "key", "row_no"]
    last = _open_rows(rows, by_key.where(few), F.col("key")).select(cols).unionByName(_open_rows(equal, by_number, F.col("row_no")).select(cols))
    run = Window.partitionBy("s").orderBy("key", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(run) - F.col("size") / 2
    taken = last.withColumn("taken", middle <= F.col("rest"))
    at = F.struct("key", "row_no")
    # nothing of the last bin taken: all before it is
    ends = taken.groupBy("s").agg(F.max(F.when(F.col("taken"), at)).alias("cut"), F.min(at).alias("first"))
    return ends.select(
        "s", F.coalesce("cut.key", "first.key").alias("cut_key"), F.coalesce("cut.row_no", F.col("first.row_no") - 1).alias("cut_no")
    ).unionByName(whole)


def _mix(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, quality: Column | None, seed: int, carry: bool) -> DataFrame:
    text = F.col("text")
    u = unit_hash(F.lit(seed), F.col("doc_id"), text)
    rows = materialize(
        docs.select(
            *[F.struct("*").alias("row")] * carry,
            "doc_id",
            F.xxhash64("text").alias("text_hash"),
            "source",
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            (-F.log(u) / (quality if quality is not None else quality_weight(text))).alias("key"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "mix",
    )
    small = rows.select("source", "size", "key", "row_no")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = materialize(
        targets(small, list(weights), max_epochs)
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("rest", F.when(F.col("epochs") < max_epochs, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0)),
        "budget",
    )
    plan = budget.join(cuts(small.where("size > 0"), budget), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "of")
    plan = materialize(plan, "plan")
    chosen = F.coalesce((F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("row_no") <= F.col("cut_no"))), F.lit(False))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.least(F.col("epochs") + chosen.cast("long"), F.lit(max_epochs))).cast("int")
    return rows.join(hinted(plan), rows["source"].eqNullSafe(plan["of"])).withColumn("copies", copies)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, quality: Column | None = None, seed: int = 42
) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, copies, taken for every row of docs."""
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return _mix(docs, weights, max_epochs, quality, seed, False).select("doc_id", "text_hash", "source", "size", "source_size", "target", "copies", taken)


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, quality: Column | None = None, seed: int = 42
) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them."""
    rows = _mix(docs, weights, max_epochs, quality, seed, True).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
