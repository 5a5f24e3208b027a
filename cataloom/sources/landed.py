"""Readers of landed records, and what they become."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text, urls
from ..schema import ITEM, SCRAPED, conform

INBOX = "sweptAt string, entries array<struct<kind: string, title: string, match: string, resaleYen: long, url: string, genre: string, eventType: string>>"


def inbox(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Entries of inbox files; of one kind."""
    rows = spark.read.schema(INBOX).option("multiLine", True).json(path).select("sweptAt", F.inline("entries"))
    return rows if kind is None else rows.where(F.col("kind") == kind)


def inbox_items(entries: DataFrame) -> DataFrame:
    """New entries as scraped items: the address as their id where it is short, else the folded title."""
    key = F.when(F.length("url") <= 300, F.col("url")).otherwise(F.concat(F.lit("t:"), text.title_form(F.col("title"))))
    x = entries.where(F.col("kind") == "new").select(F.lit("x").alias("source"), key.alias("source_id"), "title", F.coalesce("genre", text.classify_genre(F.col("title"))).alias("genre"), F.coalesce("eventType", F.lit("登場予定")).alias("event_type"), F.coalesce("url", F.lit("")).alias("url"))
    return conform(x, SCRAPED)


def items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM).parquet(path)


def text_of(raw: bytes | None, content_type: str | None = None) -> str | None:
    """A page's text, by the charset that its header or its head names, else as UTF-8; bytes that don't fit become U+FFFD."""
    if raw is None:
        return None
    found = re.search(r"charset=[\"']?([A-Za-z0-9_-]+)", content_type or "") or re.search(r"charset=[\"']?([A-Za-z0-9_-]+)", raw[:2048].decode("latin-1"))
    name = found[1].lower() if found else "utf-8"
    try:
        return raw.decode("cp932" if name in ("shift_jis", "shift-jis", "sjis", "x-sjis") else name, "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


@F.arrow_udf(StringType())
def decoded(content: pa.Array) -> pa.Array:
    """Pages as text: the charset that their head names, else UTF-8; bytes that don't fit become U+FFFD."""
    return pa.array([text_of(raw) for raw in content.to_pylist()], pa.string())


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Files of landed pages: (path, html)."""
    return spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("html"))


def extracted(pages_: DataFrame) -> DataFrame:
    """(page_id, url, title, description, links, body) of pages with (page_id, url, html)."""
    html = F.col("html")
    meta = lambda n: F.nullif(F.regexp_extract(html, rf"(?is)<meta[^>]+(?:name|property)=[\"'](?:og:)?{n}[\"'][^>]+content=[\"']([^\"']*)", 1), F.lit(""))
    title = F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    links = F.size(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href="), F.lit(0)))
    return pages_.select("page_id", "url", title.alias("title"), meta("description").alias("description"), links.alias("links"), text.strip_tags(html).alias("body"))


def products(json_text: Column) -> Column:
    """Products of a shop's JSON: array<struct<id, handle, title, price, published_at, image>>; null if broken."""
    kind = "struct<products: array<struct<id: long, handle: string, title: string, published_at: string, variants: array<struct<price: string>>, images: array<struct<src: string>>>>>"
    rows = F.from_json(json_text, kind)["products"]
    return F.transform(rows, lambda p: F.struct(p["id"].alias("id"), p["handle"].alias("handle"), p["title"].alias("title"), p["variants"][0]["price"].alias("price"), p["published_at"].alias("published_at"), p["images"][0]["src"].alias("image")))


def linked_data(html: Column) -> Column:
    """Items of a page's ItemList: array<struct<position, name, url>>."""
    body = F.regexp_extract(html, r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>", 1)
    return F.from_json(body, "struct<itemListElement: array<struct<position: int, name: string, url: string>>>")["itemListElement"]


def sitemap(xml: Column, path_pattern: str = ".*") -> Column:
    """Addresses of a sitemap whose path matches."""
    found = F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return F.filter(found, lambda u: u.rlike(path_pattern))


def same_page(a: Column, b: Column) -> Column:
    return urls.page_key(a) == urls.page_key(b)
