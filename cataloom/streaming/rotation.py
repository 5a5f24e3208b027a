"""Which detail pages were fetched and when, kept as state by page, with timers that forget what is out of the window.

The stream's twin of `ingest.rotation` and `ingest.expire`: a page's state is the last time it was fetched. The watermark is as
far behind the newest fetch as the window is long, so that it stands at the window's start: a page's timer, set to its
last fetch, goes off when that has left the window, and only fetches that have left it already are too late to count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "id long, fetched_at timestamp, live boolean"
_FETCHED = "ms long"


class _Pages(StatefulProcessor):
    """Rows of changes: a page's newer fetch, and the fetch it is forgotten with."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _FETCHED)

    @staticmethod
    def _row(key: tuple, ms: int, live: bool) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "ms": [ms], "live": [live]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.last.get()[0] if self.last.exists() else None
        newest = max(int(x["ms"].max()) for x in rows)
        if known is None or newest > known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.last.update((newest,))
            self.handle.registerTimer(newest)
            yield self._row(key, newest, True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.last.get()[0] if self.last.exists() else None
        if known is not None and known <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            yield self._row(key, known, False)

    def close(self) -> None:
        pass


def changes(fetches: DataFrame, keep: str = "30 days") -> DataFrame:
    """(id, fetched_at, live) of a stream of fetches (id, fetched_at): what is new, and what has left the window."""
    fetches.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    x = fetches.where("id is not null and fetched_at is not null").withWatermark("fetched_at", keep)
    x = x.withColumn("ms", F.unix_millis("fetched_at"))
    out = x.groupBy("id").transformWithStateInPandas(_Pages(), outputStructType="id long, ms long, live boolean", outputMode="Update", timeMode="EventTime")
    return out.select("id", F.timestamp_millis("ms").alias("fetched_at"), "live")


def fetched(spark: SparkSession, folder: str) -> DataFrame:
    """(id, fetched_at) of the pages that are in the window, of the changes written so far in batches, in whatever order."""
    rows = spark.read.schema(f"{CHANGES}, batch long").parquet(folder)
    last = rows.groupBy("id").agg(F.max("fetched_at").alias("fetched_at"), F.max_by("live", F.struct("fetched_at", ~F.col("live"))).alias("live"))
    return last.where("live").select("id", "fetched_at")


def schema_of() -> StructType:
    return StructType.fromDDL("id long, fetched_at timestamp")
