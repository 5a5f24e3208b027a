"""Sinks: feeds, sitemaps, text dumps and snapshots. Rows are made in Spark; only what is bounded becomes one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(x: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def feed_items(items: DataFrame, site: str, limit: int = 50) -> DataFrame:
    """(id, xml) of the newest items of an RSS 2.0 feed."""
    link = F.concat(F.lit(f"{site}/item/"), F.col("id").cast("string"))
    xml = F.concat(F.lit("<item><title>"), escaped(F.col("title")), F.lit("</title><link>"), link, F.lit("</link><guid>"), link, F.lit("</guid></item>"))
    return items.orderBy(F.desc("id")).limit(limit).select("id", xml.alias("xml"))


def feed(items: DataFrame, site: str, name: str, limit: int = 50) -> DataFrame:
    """One row with the whole feed: `limit` bounds it."""
    rows = feed_items(items, site, limit)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("id")).alias("o"), "xml"))), lambda r: r["xml"]), "")
    return rows.agg(F.concat(F.lit(f'<?xml version="1.0"?><rss version="2.0"><channel><title>{name}</title><link>{site}</link>'), body, F.lit("</channel></rss>")).alias("rss"))


def sitemap_urls(site: str, fixed: list[str], *frames: DataFrame) -> DataFrame:
    """(loc, lastmod) of fixed paths and of frames (path, lastmod)."""
    spark = frames[0].sparkSession
    out = spark.createDataFrame([(p, None) for p in fixed], "path string, lastmod date")
    for f in frames:
        out = out.unionByName(f.select("path", F.col("lastmod").cast("date").alias("lastmod")))
    return out.select(F.concat(F.lit(site), "path").alias("loc"), "lastmod")


def dump_lines(items: DataFrame) -> DataFrame:
    """A line for each item, to be sorted by source and id."""
    return items.select("source", "id", F.concat_ws(" | ", F.col("id").cast("string"), "source", "title", F.coalesce(F.col("event_date").cast("string"), F.lit("-"))).alias("line"))


def write_dump(items: DataFrame, folder: str) -> None:
    dump_lines(items).orderBy("source", "id").select("line").write.mode("overwrite").text(folder)


def append_events(events: DataFrame, folder: str, allowed: list[str]) -> None:
    """Events of allowed names, cut to the log's lengths."""
    prepared(events, allowed).write.mode("append").parquet(folder)


def prepared(events: DataFrame, allowed: list[str]) -> DataFrame:
    cut = {"value": 200, "data": 500, "path": 300}
    x = events.where(F.col("name").isin(*allowed))
    return x.select(*[F.substring(c, 1, cut[c]).alias(c) if c in cut else F.col(c) for c in events.columns])


def write_snapshot(df: DataFrame, folder: str, run: str) -> None:
    """A snapshot under its run's name; writing a run again replaces it."""
    df.write.mode("overwrite").parquet(f"{folder}/run={run}")
