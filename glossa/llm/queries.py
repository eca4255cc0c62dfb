"""The queries opN_<name> over the tables, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import held_out, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.sharding import shard

    out = shard(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.topk import quantise, top_k

    rows = quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return top_k(rows, rows.where("id % 100 = 0"), 10)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    langs, matrix = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), langs, matrix)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.simhash import near_groups

    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.quality import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.decontaminate import contaminated

    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_shingles", "n_found", "containment")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sharding": op2_sharding,
    "op3_topk_search": op3_topk_search,
    "op4_language_id": op4_language_id,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_decontamination": op8_decontamination,
    "op9_secrets": op9_secrets,
    "op10_html_extraction": op10_html_extraction,
    "pipeline": pipeline,
}

ORACLES = {
    "op1_line_dedup": r"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        flat AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
        keyed AS (
            SELECT doc_id, line, pos,
                translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM flat
        ),
        marked AS (
            SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op3_topk_search": """
        WITH v AS (
            SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))::BIGINT) AS vec
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ),
        pairs AS (
            SELECT q.row_no, q.vec_id AS query_id, c.vec_id,
                CAST(list_sum(list_transform(range(1, len(q.vec) + 1), lambda i: q.vec[i] * c.vec[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.row_no <> c.row_no AND len(q.vec) = len(c.vec) WHERE q.vec_id % 100 = 0
        ),
        ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                vec_id, score
            FROM pairs
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op8_decontamination": r"""
        WITH words AS (
            SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
        ),
        cut AS (
            SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM words
        ),
        shingles AS (
            SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s
            FROM cut WHERE len(ws) >= 5
        ),
        sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id)
        SELECT d.id AS doc_id, i.id AS item_id, z.n AS n_shingles, count(*) AS n_found, count(*) / z.n AS containment
        FROM shingles d JOIN shingles i ON d.kind = 'd' AND i.kind = 'i' AND d.s = i.s JOIN sizes z ON z.id = i.id
        GROUP BY d.id, i.id, z.n HAVING count(*) >= 0.8 * z.n
    """,
}
