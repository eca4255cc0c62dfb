"""The corpus pipeline: quality, near duplicates, contamination, mixing, shards.

Each stage takes what the one before has kept, as a table written in the shared folder, and works on all of it.
All stages but the last return the columns of documents; the last adds size, text_crc32, shard, slot and
grown_shard. The mixing stage repeats a document as often as the mix takes it.

Defined cases: columns of documents, whatever their names and types, are returned as they are; a column that the last stage adds
takes an underscore at its end where its name is there in any case. A null or empty text is scored as the empty text, is a near
duplicate of other blank texts and of none else, holds no benchmark item, has no words to be taken by the mix, so it goes there at
the latest. Rows without a doc_id are documents like others: they stay unless a document with an id is their near duplicate. Of
repeated rows one passes the second stage. Ties: the smaller doc_id stays, then the smaller text hash. Empty tables give empty
results; without labels the quality stage keeps everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.llm import decontaminate, mixing, quality, sharding, simhash
from glossa.llm.common import held_out, materialize, table

#: Not expressible: compression, XXH64 and Efraimidis-Spirakis draws. Each stage is tested on the smallest tables against a
#: brute-force version (tests/llm/test_queries.py).
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return quality.good(docs, model, 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs, 24)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
