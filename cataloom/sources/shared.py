"""The folder that driver and executors share, and cutting of lineage in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cataloom-')}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session has ended, and with it the JVM that could delete
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, deleted when the driver ends."""
    folder = f"{shared_folder(spark)}/cataloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows with their lineage cut: written as a table in the shared folder and read again.

    Tables of texts are as large as the input: they are packed closer than usual.
    """
    spark, folder = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out.cut_folder = folder
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what `cut` wrote, once nothing will read it again."""
    for df in tables:
        if folder := getattr(df, "cut_folder", None):
            _delete(df.sparkSession, folder)
