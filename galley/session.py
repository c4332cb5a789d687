"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session for tests and benches; on a cluster the session is made by spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("galley")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where that setting is missing a temporary folder serves a session on one machine; executors
    of a cluster don't share one, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    global _OWN
    if _OWN is None:
        _OWN = "file://" + tempfile.mkdtemp(prefix="galley-")
    return _OWN


_OWN: str | None = None


def file_system(spark: SparkSession, at: str) -> tuple[Any, Any]:
    """(the Hadoop file system of a path, the path)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as a parquet table into the shared folder and reads it back.

    It cuts the lineage, is compressed and columnar, and survives the loss of any
    executor. The folder is removed when the session ends, or by `release`.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/galley/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    fs, path = file_system(spark, at)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._galley_at = at
    return out


def release(df: DataFrame) -> None:
    """Removes a table written by `materialize` that nothing reads any more."""
    if at := getattr(df, "_galley_at", None):
        fs, path = file_system(df.sparkSession, at)
        fs.delete(path, True)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a session: their Python need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_galley_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = f"{tempfile.mkdtemp(prefix='galley-')}/galley.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"galley/{p.relative_to(root)}")
    sc.addPyFile(at)  # served to the executors by the driver
    sc._galley_shipped = True


def shipped(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that makes sure of the package on the executors first."""

    def go(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return run(spark, folder)

    return go


def cores_env(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))
