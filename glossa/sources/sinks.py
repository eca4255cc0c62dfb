"""Text and XML forms of results: columns for write.text, one per sentence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_lines(rows: DataFrame, key: list[str], order: str, line: Column) -> DataFrame:
    """(key, text): the lines of each key in order, joined."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(own, lambda x: x["l"]), "\n").alias("text"))


def predicate_arguments(slots: DataFrame, key: list[str]) -> DataFrame:
    """(key, predicate, text): one line per predicate of rows (key, predicate, word, slot, filler, overt): its word, then
    slot:filler, in brackets where no phrase of the sentence fills it; an empty slot has a dash."""
    filler = F.coalesce("filler", F.lit("-"))
    one = F.concat("slot", F.lit(":"), F.when(F.col("filler").isNull() | F.col("overt"), filler).otherwise(F.concat(F.lit("["), filler, F.lit("]"))))
    return slots.groupBy(*key, "predicate").agg(F.concat_ws(" ", F.first("word"), F.array_join(F.array_sort(F.collect_list(one)), " ")).alias("text"))


def table_text(rows: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """(key, text): a tab-separated table with a header for each key."""
    line = F.concat_ws("\t", *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\n]", " "), F.lit("")) for c in columns])
    body = ordered_lines(rows, key, order, line)
    return body.withColumn("text", F.concat(F.lit("\t".join(columns) + "\n"), "text"))


def phrase_lines(phrases: DataFrame, key: list[str]) -> DataFrame:
    """(key, text): the `* head type <feature>...` lines of phrases (phrase_no, head, dep_type, features)."""
    marks = F.concat(F.lit("<"), F.array_join("features", "><"), F.lit(">"))
    line = F.concat_ws(" ", F.lit("*"), F.concat(F.col("head").cast("string"), "dep_type"), F.when(F.size("features") > 0, marks))
    return ordered_lines(phrases, key, "phrase_no", line)


def morpheme_lines(morphemes: DataFrame, key: list[str], features: bool = True) -> DataFrame:
    """(key, text): the column lines of morphemes, with features or, as a filter, the plain columns alone."""
    names = ["surface", "reading", "lemma", "pos", "pos_id", "subpos", "subpos_id", "infl_type", "infl_type_id", "infl_form", "infl_form_id"]
    sem = F.when(F.col("sem").isNull(), "NIL").otherwise(F.concat(F.lit('"'), "sem", F.lit('"')))
    marks = F.when(F.size("features") > 0, F.concat(F.lit("<"), F.array_join("features", "><"), F.lit(">")))
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in names], sem, marks if features else F.lit(None).cast("string"))
    return ordered_lines(morphemes, key, "morph_no", line)


def _escaped(c: Column) -> Column:
    out = c.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.coalesce(out, F.lit(""))


def element(name: str, attributes: dict[str, Column], *children: Column) -> Column:
    """An XML element; children are elements or escaped text."""
    head = [F.concat(F.lit(f' {k}="'), _escaped(v), F.lit('"')) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *head, F.lit(">"), *children, F.lit(f"</{name}>"))


def records_to_xml(records: DataFrame) -> DataFrame:
    """(sent_id, xml) of records as jtab reads them: sentence, phrases and, in them, their morphemes."""
    word = lambda m: element("word", {c: m[c] for c in ("surface", "reading", "lemma", "pos", "subpos")})
    of = lambda i: F.filter("morphemes", lambda m: (m["phrase_no"] == i) & m["alternative_of"].isNull())
    phrase = lambda p, i: element("phrase", {"no": i, "head": p["head"], "type": p["dep_type"]}, F.array_join(F.transform(of(i), word), ""))
    loose = F.array_join(F.transform(of(F.lit(-1)), word), "")
    xml = element("sentence", {"id": F.col("sent_id")}, loose, F.array_join(F.transform("phrases", phrase), ""))
    return records.select("sent_id", xml.alias("xml"))


def matrix_lines(pairs: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """(key, text): the candidates of each sentence as a matrix, a line for each dependent with the type at each governor, else a dash;
    pairs (key, dependent, governor, type), sizes (key, n)."""
    cells = pairs.groupBy(*key, "dependent").agg(F.map_from_entries(F.collect_list(F.struct("governor", "type"))).alias("row"))
    every = sizes.select(*key, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("dependent"))
    filled = every.join(cells, [*key, "dependent"], "left")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.coalesce(F.try_element_at("row", j), F.lit("-"))), "")
    return ordered_lines(filled, key, "dependent", line)


def trees_text(rows: DataFrame, key: list[str], labels: str = "words", heads: str = "heads") -> DataFrame:
    """(key, tree, sexp): the tree of each row (words, heads) drawn with lines, and as an S-expression."""
    from glossa.operators.chart import draw, to_sexp

    @F.pandas_udf("tree string, sexp string")
    def run(words: pd.Series, governors: pd.Series) -> pd.DataFrame:
        made = [(draw(list(w), list(h)), to_sexp(list(w), list(h))) if len(h) else ("", "()") for w, h in zip(words, governors, strict=True)]
        return pd.DataFrame(made, columns=["tree", "sexp"])

    return rows.select(*key, run(labels, heads).alias("t")).select(*key, "t.*")


def vector_lines(rows: DataFrame, key: list[str], label: str, features: str, numbers: DataFrame) -> DataFrame:
    """(key, text): a line `label id:1 id:1 ...` for each row, features by their numbers (feature, id) in order; unknown ones are left out."""
    each = rows.select(*key, label, F.explode_outer(F.array_distinct(features)).alias("feature")).join(numbers, "feature", "left")
    ids = F.array_sort(F.collect_list("id"))
    return each.groupBy(*key, label).agg(ids.alias("ids")).select(
        *key, F.concat_ws(" ", F.col(label).cast("string"), F.transform("ids", lambda i: F.concat(i.cast("string"), F.lit(":1")))).alias("text")
    )


def result_header(records: DataFrame, score: str | None = None, warning: str | None = None, memo: str | None = None) -> DataFrame:
    """(sent_id, text): the comment line of each record with its score, error, warning and notes, those that it has."""
    note = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}:"), F.col(c).cast("string"))) if c else F.lit(None).cast("string")
    points = F.when(F.col(score).isNotNull(), F.format_string("SCORE:%.5f", F.col(score).cast("double"))) if score else F.lit(None).cast("string")
    return records.select("sent_id", F.concat_ws(" ", F.concat(F.lit("# S-ID:"), "sent_id"), "comment", points, note("ERROR", "error"), note("WARNING", warning), note("MEMO", memo)).alias("text"))


def error_header(records: DataFrame) -> DataFrame:
    """(sent_id, text): the comment line of each record with its error, if it has one."""
    note = F.when(F.col("error").isNotNull(), F.concat(F.lit("ERROR:"), "error"))
    return records.select("sent_id", F.concat_ws(" ", F.concat(F.lit("# S-ID:"), "sent_id"), "comment", note).alias("text"))
