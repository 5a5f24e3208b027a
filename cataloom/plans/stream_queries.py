"""Queries that run as streams over the driver's tables, from the landed file to what a batch query would give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import landing
from ..sources.shared import scratch
from ..streaming import events, rotation
from .catalog_queries import query, table

#: A stream reads a folder or a pattern, not a file: the table is the only one of its name.
SESSIONS = ("click", "purchase", "signup")


def _ran(query_) -> None:
    query_.awaitTermination()
    if query_.exception():
        raise query_.exception()


@query("event_stream", f"SELECT event_type AS name, count(*) AS n, min(event_id) AS first, max(event_id) AS last, max(length(props)) AS longest FROM events WHERE event_type IN {SESSIONS} GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The log's accepted events, each once, written in batches and counted."""
    raw = events.read(spark, f"{sf}/events*.parquet", table(spark, sf, "events").schema)
    named = raw.select(F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.col("event_type").alias("value"), F.col("props").alias("data"), F.lit("/").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    out, check = scratch(spark, "event-stream"), scratch(spark, "event-checks")
    rows = events.once_each(events.accepted(named, list(SESSIONS)), "id", "ts")
    _ran(events.write_batches(rows, out, check))
    got = events.written(spark, out, rows.schema)
    return got.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.length("data")).cast("long").alias("longest"))


@query(
    "fetch_stream",
    """SELECT id, max(fetched_at) AS fetched_at FROM (SELECT user_id AS id, date_trunc('milliseconds', ts) AS fetched_at FROM events) GROUP BY id
  HAVING max(fetched_at) > (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 2 HOURS""",
)
def _(spark, sf):
    """Users as pages that are fetched by their events: those of the last two hours, kept as state with timers."""
    raw = events.read(spark, f"{sf}/events*.parquet", table(spark, sf, "events").schema)
    out, check = scratch(spark, "fetch-stream"), scratch(spark, "fetch-checks")
    _ran(events.write_batches(rotation.changes(raw.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("fetched_at")), "2 hours"), out, check, mode="update"))
    return rotation.fetched(spark, out).select("id", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))


@query(
    "landed_stream",
    r"""SELECT page_id, title FROM (SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages)""",
)
def _(spark, sf):
    """Pages landed in five batches, read as a stream of new ones, decoded and read for their titles."""
    folder, out, check = (scratch(spark, x) for x in ("landed", "landed-out", "landed-checks"))
    pages = table(spark, sf, "pages").select((F.col("page_id") % 5).alias("batch"), F.struct("page_id", F.concat_ws("#", "url", "page_id").alias("url"), F.lit("text/html; charset=utf-8").alias("content_type"), F.base64(F.encode("html", "utf-8")).alias("content")).alias("p"))
    landing.land(pages.select("batch", F.to_json("p").alias("line")), folder)
    _ran(events.write_batches(landing.stream(spark, folder), out, check))
    got = spark.read.schema(landing.PAGES).parquet(out)
    html = landing.page_text("content", "content_type")
    title = F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return got.select(F.substring_index("url", "#", -1).cast("long").alias("page_id"), title.alias("title"))
