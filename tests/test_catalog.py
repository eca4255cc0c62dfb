"""Every catalogue query that SQL can state, against DuckDB on the smallest tables."""

import os
from pathlib import Path

import pytest

from glossa.plans import catalog

DATA = os.environ.get("GLOSSA_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == float:
            df[c] = df[c].round(6)
    return sorted(df.astype(str).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables of short documents, for kernels whose work grows with the cube of a sentence."""
    folder = str(tmp_path_factory.mktemp("small"))
    spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 2000").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{DATA}/conversations.parquet").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_kernel_query_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_kernel_queries_read_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name in ("cky_parse", "coord_scope", "crf_tag", "viterbi_ne"):
        assert catalog.QUERIES[name](spark, DATA).schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    ids = lambda df: {r[0] for r in df.select("doc_id").distinct().collect()}
    assert ids(catalog.QUERIES["crf_tag"](spark, DATA)) == ids(docs.where(r"text rlike '[^.!?\\s]'"))
    assert ids(catalog.QUERIES["viterbi_ne"](spark, DATA))


def test_written_records_take_little_disk(spark, tmp_path, monkeypatch):
    from glossa.plans import kernel_queries

    monkeypatch.setattr(kernel_queries, "scratch_dir", lambda _: str(tmp_path / "out"))
    assert kernel_queries.jtab_roundtrip(spark, DATA).count() > 0
    written = sum(f.stat().st_size for f in (tmp_path / "out").iterdir())
    assert written < 2.5 * os.path.getsize(f"{DATA}/documents.parquet")  # as plain text over ten times


def test_parsed_trees_are_trees(spark):
    for r in catalog.QUERIES["cky_parse"](spark, DATA).collect():
        n = len(r["heads"])
        assert r["heads"][-1] == -1 and all(i < h < n for i, h in enumerate(r["heads"][:-1]))


def test_library_stands_without_llm():
    for f in Path(__file__).parents[1].glob("glossa/**/*.py"):
        if "llm" not in f.parts:
            assert "glossa.llm" not in f.read_text()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
