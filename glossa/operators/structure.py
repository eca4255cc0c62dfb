"""Sentences, tokens and phrases, built inside the row: one row per sentence with arrays, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = r"[^.!?\n]+[.!?]*"
TOKEN = r"[^ \t\r\n]+"
FUNCTION = r"^\p{Ll}{1,3}[,.!?]*$"


def _columns(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def sentences(docs: DataFrame, key: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent_no, sentence): trimmed, numbered from 0 among those that aren't blank."""
    found = F.filter(F.transform(F.regexp_extract_all(F.col(text), F.lit(SENTENCE), F.lit(0)), lambda s: F.btrim(s)), lambda s: s != "")
    return docs.select(*_columns(key), F.posexplode(found).alias("sent_no", "sentence"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def is_function(token: Column) -> Column:
    """Short lower-case words stand for function words."""
    return token.rlike(FUNCTION)


def phrase_starts(ts: Column) -> Column:
    """A phrase starts at the first token and at each content token."""
    return F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | ~is_function(F.get(ts, i)))


def spans(starts: Column, n: Column) -> Column:
    """array<struct<first, last>> of the runs that begin at `starts`, a column (an expression would be computed for
    each run), of n items."""
    return F.transform(
        starts,
        lambda s, i: F.struct(s.alias("first"), (F.coalesce(F.get(starts, i + 1), n) - 1).alias("last")),
    )


def reaches(barriers: Column, n: Column) -> Column:
    """For each of n units the next barrier after it, or else the last unit; from the barriers' positions in order.

    Units between two barriers share their answer, so it is one repeated value for each stretch.
    """
    ends = F.array_append(barriers, n - 1)

    def stretch(end: Column, i: Column) -> Column:
        before = F.when(i == 0, 0).otherwise(F.get(barriers, i - 1))
        return F.array_repeat(end, F.when(i == F.size(barriers), n - before).otherwise(end - before))

    return F.flatten(F.transform(ends, stretch))


def phrase_arrays(sents: DataFrame, key: str | list[str] = "doc_id", barrier: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, sent_no, ps): the phrases of each sentence as an array of structs (first_tok, n_tok, head, last): head is its
    last content token, or else its first token; last its last token. With a barrier, a predicate on last tokens, also
    `reach`, the next phrase where it holds or else the sentence's last. All inside the sentence's row, so nothing is
    shuffled."""
    keys = _columns(key)
    base = sents.select(*keys, "sent_no", tokens(F.col("sentence")).alias("ts")).where(F.size("ts") > 0)
    started = base.select(*keys, "sent_no", "ts", phrase_starts(F.col("ts")).alias("starts"))
    ts = F.col("ts")

    def one(span: Column) -> Column:
        # a content token can only be the first of a phrase, and a phrase without one begins the sentence
        return F.struct(
            span["first"].alias("first_tok"), (span["last"] - span["first"] + 1).alias("n_tok"), F.get(ts, span["first"]).alias("head"), F.get(ts, span["last"]).alias("last")
        )

    made = started.select(*keys, "sent_no", F.transform(spans(F.col("starts"), F.size("ts")), one).alias("ps"))
    if barrier is None:
        return made
    at = F.filter(F.sequence(F.lit(0), F.size("ps") - 1), lambda i: barrier(F.get("ps", i)["last"]))
    marked = made.select(*keys, "sent_no", "ps", at.alias("bs")).select(*keys, "sent_no", "ps", reaches(F.col("bs"), F.size("ps")).alias("rs"))
    fields = ("first_tok", "n_tok", "head", "last")
    both = F.arrays_zip(F.col("ps").alias("p"), F.col("rs").alias("reach"))
    return marked.select(*keys, "sent_no", F.transform(both, lambda z: F.struct(*[z["p"][f].alias(f) for f in fields], z["reach"].alias("reach"))).alias("ps"))


def phrases(sents: DataFrame, key: str | list[str] = "doc_id", barrier: Callable[[Column], Column] | None = None) -> DataFrame:
    """phrase_arrays with a row for each phrase: (key, sent_no, phrase_no, first_tok, n_tok, head, last and, with a barrier, reach)."""
    keys = _columns(key)
    # outer: from the plain form Catalyst infers a filter on the array, and computes it once more to push that down
    return phrase_arrays(sents, key, barrier).select(*keys, "sent_no", F.posexplode_outer("ps").alias("phrase_no", "p")).select(*keys, "sent_no", "phrase_no", "p.*")


def merge_runs(rows: DataFrame, partition: list[str], order: list[str], mark: Column, most: int | None = None) -> DataFrame:
    """Number the runs of equal marks (`run`); a null mark is never merged, nor is a run longer than `most`."""
    from pyspark.sql import Window

    w = Window.partitionBy(*partition).orderBy(*order)
    before = F.lag("_mark").over(w)
    new = F.when(F.col("_mark").isNotNull() & (before == F.col("_mark")), 0).otherwise(1)
    out = rows.withColumn("_mark", mark).withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    if most is not None:
        size = F.count("*").over(Window.partitionBy(*partition, "run"))
        out = out.withColumn("_long", size > most).withColumn("_new", F.when(F.col("_long"), 1).otherwise(F.col("_new"))).withColumn("run", F.sum("_new").over(w)).drop("_long")
    return out.drop("_mark", "_new")


def bracket_depths(c: Column, opening: str, closing: str) -> Column:
    """struct<deepest, ends, lowest> of the running sum of brackets, +1 before an opening one, -1 after a closing."""
    marks = F.regexp_extract_all(c, F.lit(f"[{opening}{closing}]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("deepest"), F.lit(0).alias("ends"), F.lit(0).alias("lowest"))

    def step(s: Column, m: Column) -> Column:
        now = s["ends"] + F.when(m == opening, 1).otherwise(-1)
        return F.struct(F.greatest(s["deepest"], now).alias("deepest"), now.alias("ends"), F.least(s["lowest"], now).alias("lowest"))

    return F.aggregate(marks, zero, step)


def split_brackets(rows: DataFrame, id_col: str, text: str, opening: str = "(", closing: str = ")") -> DataFrame:
    """The main text and one row per outermost bracketed part: (id, part_no, part); part 0 is the main text.

    An opening bracket that isn't closed holds the rest; a closing one that wasn't opened is text.
    """
    both = re.escape(opening) + re.escape(closing)
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"[^{both}]+|[{both}]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("main"), F.lit("").alias("open"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, ch: Column) -> Column:
        up, down = ch == opening, (ch == closing) & (s["depth"] > 0)
        depth = s["depth"] + F.when(up, 1).when(down, -1).otherwise(0)
        inside = F.when(up & (s["depth"] == 0), "").when(down & (depth == 0), "").when(s["depth"] > 0, F.concat(s["open"], ch)).otherwise("")
        parts = F.when(down & (depth == 0), F.array_append(s["parts"], s["open"])).otherwise(s["parts"])
        main = F.when((s["depth"] == 0) & ~up, F.concat(s["main"], ch)).otherwise(s["main"])
        return F.struct(depth.alias("depth"), main.alias("main"), inside.alias("open"), parts.alias("parts"))

    done = F.aggregate(pieces, zero, step)
    all_parts = F.concat(F.array(done["main"]), done["parts"], F.when(done["open"] != "", F.array(done["open"])).otherwise(F.array().cast("array<string>")))
    return rows.select(id_col, F.posexplode(all_parts).alias("part_no", "part"))
