"""Named entities as relations: transfer of labels to units, a cache of labels seen in the article, query terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entity_spans(tags: DataFrame, key: list[str], order: str, label: str = "label", surface: str = "surface") -> DataFrame:
    """(key, first, last, kind, text) of each entity from labels kind:head|middle|tail|single, by running sums."""
    w = Window.partitionBy(*key).orderBy(order)
    place = F.substring_index(label, ":", -1)
    rows = tags.where(F.col(label) != "OTHER").withColumn("kind", F.substring_index(label, ":", 1)).withColumn("_new", place.isin("head", "single").cast("int"))
    numbered = rows.withColumn("_entity", F.sum("_new").over(w))
    own = F.array_sort(F.collect_list(F.struct(order, surface)))
    return numbered.groupBy(*key, "_entity").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.first("kind").alias("kind"), F.array_join(F.transform(own, lambda x: x[surface]), "").alias("text")
    ).drop("_entity")


def entity_arrays(tokens: str, labels: str) -> Column:
    """entity_spans inside a sentence's row, from arrays of its tokens and of their labels: array<struct<first, last, kind, text>>."""
    all_ = F.transform(tokens, lambda t, i: F.struct(i.alias("at"), t.alias("surface"), F.get(labels, i).alias("label")))
    marked = F.filter(all_, lambda m: m["label"] != "OTHER")

    def spans(ms: Column) -> Column:
        starts = F.filter(F.transform(ms, lambda m, i: F.when((i == 0) | m["label"].endswith(":head") | m["label"].endswith(":single"), i)), lambda i: i.isNotNull())
        return F.get(F.transform(F.array(starts), lambda at: F.transform(at, lambda a, k: told(F.slice(ms, a + 1, F.coalesce(F.get(at, k + 1), F.size(ms)) - a)))), 0)

    def told(own: Column) -> Column:
        first = F.get(own, 0)
        return F.struct(
            first["at"].alias("first"), F.get(own, F.size(own) - 1)["at"].alias("last"), F.substring_index(first["label"], ":", 1).alias("kind"),
            F.array_join(F.transform(own, lambda m: m["surface"]), "").alias("text"),
        )

    return F.get(F.transform(F.array(marked), spans), 0)  # a lambda's argument is computed once


def entities_to_units(spans: DataFrame, units: DataFrame, key: list[str]) -> DataFrame:
    """The unit (key, unit_no, first, last) that holds an entity's last token gets its kind and text."""
    s = spans.select(*key, F.col("last").alias("_at"), "kind", "text")
    u = units.withColumnsRenamed({"first": "_first", "last": "_last"})
    return u.join(s, key).where("_at BETWEEN _first AND _last").select(*key, "unit_no", "kind", "text")


def cached_label(rows: DataFrame, article: str, order: str, term: str, label: str) -> DataFrame:
    """rows with `cached`, the label that the term had last in an earlier sentence of the article."""
    w = Window.partitionBy(article, term).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("cached", F.last(F.when(F.col(label) != "OTHER", F.col(label)), ignorenulls=True).over(w))


def query_terms(rows: DataFrame, key: str, term: Column) -> DataFrame:
    """(key, term, n): how often a term is in a document."""
    return rows.groupBy(key, term.alias("term")).agg(F.count("*").alias("n"))


def merge_parentheses(main: DataFrame, parts: DataFrame) -> DataFrame:
    """Sentences with their split-out parentheses put back: main (sent_id, text with a mark \\u0001 for each part), parts (sent_id
    `<main>-<two digits>`, text), in the order of the digits."""
    own = parts.select(F.regexp_extract("sent_id", r"^(.*)-\d{2}$", 1).alias("sent_id"), F.struct(F.regexp_extract("sent_id", r"-(\d{2})$", 1).cast("int").alias("no"), "text").alias("p"))
    gathered = own.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["text"]).alias("parts"))
    pieces = F.split("text", "\u0001", -1)
    joined = main.join(gathered, "sent_id", "left").withColumn("_pieces", pieces)
    filled = F.transform("_pieces", lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.coalesce(F.get("parts", i - 1), F.lit("")), x)))
    return joined.select("sent_id", F.array_join(filled, "").alias("text"))
