"""Catalogue queries of rule sets and basic units over the sentences of documents, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import units
from glossa.operators.structure import is_function, sentences, tokens
from glossa.plans.session import table
from glossa.plans.text_queries import TOKENS
from glossa.sources import sexpr

MORPHEME_RULES = """
    ("" "[pos=function]" ? ("function"))
    ("[pos=name]" "[pos=name]" ? ("named"))
    (? ? ? ("initial"))
    ("" "[pos=number]" "[pos=word]" ("quantity" "&case:number"))
"""
LATER_RULES = """
    ("[function]" "[pos=name]" ? ("after-function" "&spread:-1:before-name"))
    ("" "[&length:12]" ? ("long"))
    ("" "[&number:ge:1000 ^initial]" ? ("large"))
"""


def _token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents")).select("doc_id", "sent_no", tokens(F.col("sentence")).alias("ts"))


def rule_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rule sets in order: by rule, then by unit with a stop after the first match."""
    from glossa.operators.rules import RuleSet, apply_sets

    pos = lambda t: F.when(t.rlike(r"^\p{Lu}"), "name").when(t.rlike("^[0-9]"), "number").when(is_function(t), "function").otherwise("word")
    rows = _token_rows(spark, sf_dir).select("doc_id", "sent_no", F.transform("ts", lambda t: F.struct(t.alias("surface"), F.lower(t).alias("lemma"), pos(t).alias("pos"))).alias("units"))
    sets = [sexpr.morpheme_rules(MORPHEME_RULES, by="rule"), RuleSet("later", tuple(sexpr.rules(LATER_RULES)), leave="normal")]
    found = apply_sets(rows, sets, ["doc_id", "sent_no"])
    return found.select("doc_id", F.explode(F.flatten("features")).alias("feature")).groupBy("doc_id", "feature").agg(F.count("*").alias("n"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = lambda t: ~is_function(t)
    return units.unit_arrays(
        _token_rows(spark, sf_dir), ["doc_id", "sent_no"], "ts",
        phrase=content, unit=lambda t: F.char_length(t) == 3, prefix=lambda t: F.char_length(t) == 1, content=content, semi=lambda t: t.rlike("[,.!?]$"),
    )


def tag_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units start at content words and at words of three letters."""
    found = _units(spark, sf_dir).select("doc_id", "sent_no", F.posexplode_outer("us").alias("unit_no", "u")).select("doc_id", "sent_no", "unit_no", "u.*")
    return found.withColumns({c: F.col(c).cast("long") for c, t in found.dtypes if t == "int"})


def unit_end_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _units(spark, sf_dir).select("doc_id", F.explode_outer(units.from_end("us")).alias("from_end"))
    return at.groupBy("doc_id", F.col("from_end").cast("long").alias("from_end")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (rule_apply, tag_units, unit_end_index)}

UNITS = (
    TOKENS
    + r""",
    starts AS (
        SELECT *, tok_no = 0 OR NOT fn AS phrase_start, tok_no = 0 OR NOT fn OR length(tok) = 3 AS unit_start FROM marked
    ),
    unit_nos AS (
        SELECT *, sum(phrase_start::INT) OVER w - 1 AS phrase_no, sum(unit_start::INT) OVER w - 1 AS unit_no FROM starts WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no)
    )
"""
)

ORACLES = {
    "rule_apply": f"""
        WITH {TOKENS}, posed AS (
            SELECT *, CASE WHEN regexp_matches(tok, '^\\p{{Lu}}') THEN 'name' WHEN regexp_matches(tok, '^[0-9]') THEN 'number' WHEN fn THEN 'function' ELSE 'word' END AS pos FROM marked
        ),
        around AS (SELECT *, lag(pos) OVER w AS before, lead(pos) OVER w AS after FROM posed WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no)),
        later AS (
            SELECT *, CASE WHEN before = 'function' AND pos = 'name' THEN 'after-function' WHEN length(tok) >= 12 THEN 'long'
                WHEN tok_no > 0 AND CASE WHEN regexp_full_match(tok, '-?[0-9]+([.][0-9]+)?') THEN TRY_CAST(tok AS DOUBLE) >= 1000 ELSE tok >= '1000' END THEN 'large' END AS found
            FROM around
        ),
        marks AS (
            SELECT doc_id, unnest([
                CASE WHEN pos = 'function' THEN 'function' END, CASE WHEN before = 'name' AND pos = 'name' THEN 'named' END, CASE WHEN tok_no = 0 THEN 'initial' END,
                CASE WHEN pos = 'number' AND after = 'word' THEN 'quantity' END, CASE WHEN pos = 'number' AND after = 'word' THEN 'cases:number' END,
                found, CASE WHEN pos = 'function' AND after = 'name' THEN 'before-name' END]) AS feature
            FROM later
        )
        SELECT doc_id, feature, count(*) AS n FROM marks WHERE feature IS NOT NULL GROUP BY ALL""",
    "tag_units": f"""
        WITH {UNITS}
        SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, CAST(unit_no AS BIGINT) AS unit_no, CAST(any_value(phrase_no) AS BIGINT) AS phrase_no, CAST(min(tok_no) AS BIGINT) AS "first", CAST(max(tok_no) AS BIGINT) AS "last",
            count(*) FILTER (length(tok) = 1) AS n_prefix, count(*) FILTER (NOT fn AND length(tok) <> 1) AS n_content, count(*) FILTER (fn AND length(tok) <> 1) AS n_suffix,
            CAST(coalesce(max(tok_no) FILTER (NOT fn OR regexp_matches(tok, '[,.!?]$')), min(tok_no)) AS BIGINT) AS head
        FROM unit_nos GROUP BY doc_id, sent_no, unit_no""",
    "unit_end_index": f"""
        WITH {UNITS}, numbered AS (SELECT doc_id, max(tok_no) OVER (PARTITION BY doc_id, sent_no, unit_no) - tok_no AS from_end FROM unit_nos)
        SELECT doc_id, CAST(from_end AS BIGINT) AS from_end, count(*) AS n FROM numbered GROUP BY ALL""",
}
