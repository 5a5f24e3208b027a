"""Snapshots of runs read back, and how their schemas differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def runs(spark: SparkSession, folder: str) -> list[str]:
    """Names of the snapshots in a folder, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.listStatus(path) if files.exists(path) else []
    return sorted(s.getPath().getName().removeprefix("run=") for s in found if s.isDirectory() and s.getPath().getName().startswith("run="))


def load(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """A snapshot as it was written, with its own schema."""
    return spark.read.parquet(f"{folder}/run={run}")


def columns(kind: DataType, at: str = "") -> dict[str, str]:
    """Type by path of a schema's columns; fields of structs after a dot, elements of arrays as [], keys and values of maps as {}."""
    if isinstance(kind, StructType):
        out: dict[str, str] = {at: "struct"} if at else {}
        for f in kind.fields:
            out |= columns(f.dataType, f"{at}.{f.name}" if at else f.name)
        return out
    if isinstance(kind, ArrayType):
        return {at: "array"} | columns(kind.elementType, f"{at}[]")
    if isinstance(kind, MapType):
        return {at: "map"} | columns(kind.keyType, f"{at}{{key}}") | columns(kind.valueType, f"{at}{{}}")
    return {at: kind.simpleString()}


def schema_changes(before: StructType, now: StructType) -> list[tuple[str, str, str | None, str | None]]:
    """(change, column, was, is) of columns that are lost, added or retyped, by column; below one that is lost or added nothing more is told."""
    a, b = columns(before), columns(now)
    out = []
    for c in sorted(a.keys() | b.keys()):
        change = "added" if c not in a else "lost" if c not in b else "retyped" if a[c] != b[c] else None
        below = any(c.startswith(x) and c[len(x) : len(x) + 1] in (".", "[", "{") for _, x, *_ in out)
        if change and not below:
            out.append((change, c, a.get(c), b.get(c)))
    return out


def drift(spark: SparkSession, folder: str) -> DataFrame:
    """(change, column, was, is, rows_before, rows) of a folder's last two snapshots; none with fewer."""
    last = runs(spark, folder)[-2:]
    schema = "change string, column string, was string, `is` string"
    if len(last) < 2:
        return spark.createDataFrame([], f"{schema}, rows_before long, rows long")
    before, now = (load(spark, folder, r) for r in last)
    counts = before.agg(F.count("*").alias("rows_before")).crossJoin(now.agg(F.count("*").alias("rows")))  # one row each
    return spark.createDataFrame(schema_changes(before.schema, now.schema), schema).crossJoin(F.broadcast(counts))
