"""Shared helpers of the training-data operators: text rules, tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.plans.session import ship

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_fallback: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; the plain `lower` where the text is ASCII, for speed."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(c: Column) -> Column:
    """Lower-cased words of a text, split at ASCII white space; null and blank texts give an empty array."""
    flat = F.btrim(F.coalesce(ascii_lower(c), F.lit("")), F.lit(SPACES))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, r"[\x20\x09-\x0D]+", -1))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode, where it is unset, one temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="glossa-"))
        atexit.register(shutil.rmtree, _fallback[0], True)
    return "file://" + _fallback[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it again: cuts lineage, survives lost executors.

    The table lives as long as the folder does; results are lazy and may still read it, so nothing is removed here.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glossa/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few longs that may be broadcast: some 100 MB in an executor.
BROADCAST_ROWS = 1_000_000


def hinted(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, a materialised table of few narrow columns, marked for broadcast if it's counted to have at most that many rows."""
    return F.broadcast(df) if df.count() <= most else df


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores at its end while a column is called so in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def unit_hash(*cols: Column) -> Column:
    """A uniform double in (0, 1] from the columns, equal on every run."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + F.lit(1)).cast("double") / F.lit(float(2**53))


def held_out() -> Column:
    """The fold that nothing is learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
