"""Longest matches by a table's keys: hosts by the domains they are under, texts by the places they begin with.

A row is looked up by each key it could have (its host without one label after another, its text's beginnings up to the
longest key), in one equality join; the longest that is there stands. No key is compared with every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

#: A host has at most 127 labels by its length; longer ones are none.
MOST_LABELS = 127


def _longest(asked: DataFrame, table: DataFrame) -> DataFrame:
    """(id, key, value) of rows (id, key) and a table (key, value): of a row's keys that are there the longest, of equal keys the least value."""
    own = table.where("length(key) > 0").groupBy("key").agg(F.min("value").alias("value"))
    best = asked.join(own, "key").groupBy("id").agg(F.max_by(F.struct("key", "value"), F.struct(F.length("key"), "key")).alias("m"))
    return best.select("id", "m.key", "m.value")


def under(host: Column) -> Column:
    """A host and the domains above it: www.a.example gives itself, a.example and example."""
    labels = F.split(F.regexp_replace(F.lower(host), r"\.+$", ""), r"\.")
    fine = (F.size(labels) <= MOST_LABELS) & ~F.exists(labels, lambda x: x == "")
    return F.when(fine, F.transform(labels, lambda _, k: F.array_join(F.slice(labels, k + 1, F.size(labels)), ".")))


def by_host(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(id, key, value) of rows (id, host) under a domain of the table (key, value): the most exact one."""
    return _longest(rows.select("id", F.explode(under(F.col("host"))).alias("key")).distinct(), table)


def by_beginning(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(id, key, value) of rows (id, text) that begin with a key of the table: the longest one. Keys' greatest length bounds the beginnings."""
    most = table.agg(F.max(F.length("key"))).first()[0] or 0
    size = F.least(F.length("text"), F.lit(most))
    begins = F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda n: F.substring("text", 1, n)))
    return _longest(rows.select("id", F.explode(begins).alias("key")).distinct(), table)


def written_place(venue: Column) -> Column:
    """The place that a venue's name is marked with at its beginning, 【東京/原宿】 say; null without such a mark.

    Only what is written counts: a shop's name doesn't tell where it is.
    """
    mark = F.when(venue.startswith("【"), F.substring_index(F.substr(venue, F.lit(2)), "】", 1))
    first = F.split(mark, "[/／]")
    return F.when(F.size(first) > 1, F.nullif(F.trim(first[0]), F.lit("")))


def foreign_images(items: DataFrame, shops: DataFrame) -> DataFrame:
    """(finding, id, shop) of items (id, source, image_url) whose picture lies with a shop (key: domain, value: source) that isn't their own."""
    hosts = items.select("id", urls.host(F.col("image_url")).alias("host")).where("host is not null")
    found = by_host(hosts, shops).join(items.select("id", "source"), "id").where(~F.col("value").eqNullSafe(F.col("source")))
    return found.select(F.lit("image_from_store_page").alias("finding"), "id", F.col("value").alias("shop"))
