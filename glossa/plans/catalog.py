"""All catalogue queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import structure
from glossa.plans import frame_queries, function_queries, kernel_queries, rule_queries, table_queries, text_queries
from glossa.plans.session import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: phrases, and the mean distance to the head that relaxation gives, the next barrier or the end."""
    docs = table(spark, sf_dir, "documents")
    sents = structure.sentences(docs, ["doc_id", "lang"])
    reaching = structure.phrases(sents, ["doc_id", "lang"], lambda last: last.endswith(","))
    return reaching.groupBy("lang").agg(
        F.count("*").alias("phrases"), F.round(F.sum(F.col("reach") - F.col("phrase_no")) / F.count("*"), 6).alias("mean_distance")
    )


QUERIES = {"flagship": flagship} | text_queries.QUERIES | table_queries.QUERIES | kernel_queries.QUERIES | rule_queries.QUERIES | frame_queries.QUERIES | function_queries.QUERIES
ORACLES = text_queries.ORACLES | table_queries.ORACLES | kernel_queries.ORACLES | rule_queries.ORACLES | frame_queries.ORACLES | function_queries.ORACLES | {
    "flagship": f"""
        WITH {text_queries.REACH}, per AS (SELECT doc_id, count(*) AS n, sum(reach - phrase_no) AS d FROM reaching GROUP BY doc_id)
        SELECT lang, CAST(sum(n) AS BIGINT) AS phrases, round(sum(d) / sum(n), 6) AS mean_distance FROM per JOIN documents USING (doc_id) GROUP BY lang""",
}
