"""Log-probability look-ups with floors, backoff and interpolation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Log floors: a count of zero, an unknown case or frame, an unknown adverbial.
ZERO, UNKNOWN_CASE, UNKNOWN_ADVERB = 1e-6, 1e-5, 1e-7


def floored_log(p: Column, floor: float = ZERO) -> Column:
    return F.when(F.coalesce(p, F.lit(0.0)) > 0, F.log(p)).otherwise(F.log(F.lit(floor)))


def interpolated(specific: Column, count: Column, general: Column) -> Column:
    """weight * specific + (1 - weight) * general with weight = count / (count + 1)."""
    weight = F.coalesce(count, F.lit(0)) / (F.coalesce(count, F.lit(0)) + 1)
    return weight * F.coalesce(specific, F.lit(0.0)) + (1 - weight) * F.coalesce(general, F.lit(0.0))


def unfilled(p: Column, floor: float = ZERO) -> Column:
    """Log probability that a slot stays empty."""
    return floored_log(1 - F.coalesce(p, F.lit(0.0)), floor)


def keyed_log(rows: DataFrame, table: DataFrame, on: Sequence[str], out: str, floor: float = ZERO) -> DataFrame:
    """rows with `out`, the log of table's p (on..., p) by equal keys, the floor's where it has none. For the probabilities that one key
    answers: relative clauses, topics, punctuation, the topic particle, the function of a surface case, clauses by clauses,
    adverbs (floor UNKNOWN_ADVERB), coordination and noun by noun."""
    known = table.select(*[F.col(c).alias(f"_{c}") for c in on], F.col("p").alias("_p"))
    at = reduce(Column.__and__, (F.col(c) == F.col(f"_{c}") for c in on))
    return rows.join(known, at, "left").withColumn(out, floored_log(F.col("_p"), floor)).drop(*[f"_{c}" for c in on], "_p")


def backoff_log(rows: DataFrame, table: DataFrame, levels: Sequence[Sequence[str]], out: str, floor: float = ZERO) -> DataFrame:
    """rows with `out`, the log of the first p that table (key, p) has by a level's key, and `level`; null where none has it."""
    return backoff(rows, table, levels, "p").withColumn(out, floored_log(F.col("p"), floor)).drop("p")


def frame_log(counts: DataFrame) -> DataFrame:
    """counts (predicate, frame, n) with log_p, the log of P(frame | predicate)."""
    total = F.sum("n").over(Window.partitionBy("predicate"))
    return counts.withColumn("log_p", floored_log(F.col("n") / total, UNKNOWN_CASE))


def case_count_log(rows: DataFrame, by_frame: DataFrame, by_predicate: DataFrame) -> DataFrame:
    """rows (frame, predicate, n) with log_p, the log of P(n slots | frame): the frame's share, from by_frame (frame, n, k), interpolated
    with the predicate's, from by_predicate (predicate, n, p), by the frame's number of cases; the predicate's alone where the frame
    was never seen; the floor of an unknown case where neither has n."""
    seen = by_frame.groupBy(F.col("frame").alias("_f")).agg(F.sum("k").alias("_d"))
    own = by_frame.select(F.col("frame").alias("_g"), F.col("n").alias("_n"), F.col("k").alias("_k"))
    general = by_predicate.select(F.col("predicate").alias("_q"), F.col("n").alias("_m"), F.col("p").alias("_p"))
    joined = rows.join(seen, F.col("frame") == F.col("_f"), "left")
    joined = joined.join(own, (F.col("frame") == F.col("_g")) & (F.col("n") == F.col("_n")), "left")
    joined = joined.join(general, (F.col("predicate") == F.col("_q")) & (F.col("n") == F.col("_m")), "left")
    p = interpolated(F.coalesce(F.col("_k"), F.lit(0)) / F.col("_d"), F.col("_d"), F.col("_p"))
    return joined.withColumn("log_p", floored_log(p, UNKNOWN_CASE)).drop("_f", "_d", "_g", "_n", "_k", "_q", "_m", "_p")


def best_log(rows: DataFrame, table: DataFrame, keys: Sequence[Column], out: str, floor: float = ZERO) -> DataFrame:
    """rows with `out`, the log of the largest p that table (key, p) has for any of the keys: a word's general form, its own form,
    its alternatives, its entity and its category."""
    out_rows, found = rows, []
    for i, key in enumerate(keys):
        own = table.select(F.col("key").alias(f"_k{i}"), F.col("p").alias(f"_p{i}"))
        out_rows = out_rows.join(own, key == F.col(f"_k{i}"), "left")
        found.append(F.coalesce(F.col(f"_p{i}"), F.lit(0.0)))
    best = F.greatest(*found) if len(found) > 1 else found[0]
    return out_rows.withColumn(out, floored_log(best, floor)).drop(*[f"_{x}{i}" for i in range(len(keys)) for x in "kp"])


def category_backoff(rows: DataFrame, words: DataFrame, slots: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, p): for rows (by, word, slot, categories array) the largest P(word | category) P(category | slot) over the row's categories, from
    words (word, category, p) and slots (slot, category, p); 0 where no category has both. `by` tells rows apart."""
    each = rows.select(*by, "word", "slot", F.explode_outer("categories").alias("category"))
    p = each.join(words.withColumnRenamed("p", "_w"), ["word", "category"], "left").join(slots.withColumnRenamed("p", "_s"), ["slot", "category"], "left")
    return p.groupBy(*by).agg(F.max(F.coalesce(F.col("_w") * F.col("_s"), F.lit(0.0))).alias("p"))


def frame_similarity(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs (a, b) of frame names `verb` and number, with `similarity`: 1 for the same, else by table (key, sim) whose key has the
    frame of the smaller number first, `a-b`; 0 where the table hasn't the pair."""
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")
    swapped = number("a") > number("b")
    key = F.when(swapped, F.concat_ws("-", "b", "a")).otherwise(F.concat_ws("-", "a", "b"))
    known = table.select(F.col("key").alias("_key"), F.col("sim").alias("_sim"))
    joined = pairs.join(known, key == F.col("_key"), "left")
    return joined.withColumn("similarity", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("_sim", F.lit(0.0)))).drop("_key", "_sim")


def case_log(rows: DataFrame, by_frame: DataFrame, by_predicate: DataFrame) -> DataFrame:
    """rows (frame, predicate, slot, filled) with log_p: the frame's share of the slot, k of d from by_frame (frame, slot, k, d), interpolated
    with the predicate's p from by_predicate (predicate, slot, p); its complement where the slot is empty; floored."""
    own = by_frame.select(F.col("frame").alias("_f"), F.col("slot").alias("_s"), (F.col("k") / F.col("d")).alias("_p"), F.col("d").alias("_d"))
    general = by_predicate.select(F.col("predicate").alias("_q"), F.col("slot").alias("_t"), F.col("p").alias("_g"))
    joined = rows.join(own, (F.col("frame") == F.col("_f")) & (F.col("slot") == F.col("_s")), "left")
    joined = joined.join(general, (F.col("predicate") == F.col("_q")) & (F.col("slot") == F.col("_t")), "left")
    p = interpolated(F.col("_p"), F.col("_d"), F.col("_g"))
    return joined.withColumn("log_p", F.when(F.col("filled"), floored_log(p, UNKNOWN_CASE)).otherwise(unfilled(p))).drop("_f", "_s", "_p", "_d", "_q", "_t", "_g")


def class_probability(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum over classes of P(class | slot) / P(class) * P(word | class), from rows that have these three."""
    term = F.when(F.col("p_class") > 0, F.col("p_class_slot") / F.col("p_class") * F.col("p_word_class")).otherwise(0.0)
    return joined.groupBy(*keys).agg(F.sum(term).alias("p"))


def backoff(rows: DataFrame, table: DataFrame, levels: Sequence[Sequence[str]], value: str, key: str = "key") -> DataFrame:
    """rows with `value` and `level` (from 1) of the first level whose key is in table (key, value).

    A level's key is its columns joined by |. Each level is one equi-join, so Catalyst broadcasts the table
    where it is small and shuffles it where it isn't.
    """
    out = rows
    found, level = [], []
    for i, columns in enumerate(levels, 1):
        own = table.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        out = out.join(own, F.concat_ws("|", *[F.col(c).cast("string") for c in columns]) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
        level.append(F.when(F.col(f"_v{i}").isNotNull(), F.lit(i)))
    used = [c for i in range(1, len(levels) + 1) for c in (f"_k{i}", f"_v{i}")]
    return out.withColumns({value: F.coalesce(*found), "level": F.coalesce(*level)}).drop(*used)
