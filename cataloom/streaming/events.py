"""The event log as a stream: the batch sink's filter and cuts, each event once, and counts by windows with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.urls import is_countable_agent
from ..sources.sinks import prepared


def read(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def accepted(events: DataFrame, allowed: list[str], agent: str | None = None) -> DataFrame:
    rows = events if agent is None else events.where(is_countable_agent(F.col(agent)))
    return prepared(rows, allowed)


def once_each(events: DataFrame, id_: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Each event once, however often it is sent within `late` of its time; those that come later than that are dropped.

    An event without a time is never late and never forgotten, so it is left out; one without an id counts as one event.
    """
    return events.where(F.col(at).isNotNull()).withWatermark(at, late).dropDuplicatesWithinWatermark([id_])


def windowed(events: DataFrame, at: str = "ts", size: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def append(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_batches(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes each batch under its number. A batch that is run again after a stop replaces what it wrote before: every row is there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def written(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """What `write_batches` wrote, with the number of its batch."""
    return spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(folder)
