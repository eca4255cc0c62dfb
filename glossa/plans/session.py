"""Tables and session settings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context; where it came in an archive they have it."""
    context, root = spark.sparkContext, Path(__file__).parents[1]
    if getattr(context, "_glossa_shipped", False) or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="glossa-ship-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/glossa_package.zip", "w") as archive:
        for f in sorted(root.rglob("*.py")):
            archive.write(f, f.relative_to(root.parent))
    context.addPyFile(f"{folder}/glossa_package.zip")
    context._glossa_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder of spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="glossa-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
    return f"{at.rstrip('/')}/glossa/{uuid.uuid4().hex}"
