"""Landing: upsert with a policy for each column, reconciling deletes, renames, windows, and the paging rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("source", "source_id")


def upsert(current: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = KEY, overwrite: tuple[str, ...] = (), keep: tuple[str, ...] = (), merge: dict | None = None) -> DataFrame:
    """The next snapshot. overwrite: incoming even if null; keep: the old value where incoming is null; merge: name -> f(old, new).

    Columns in none of the three stay as they were. Incoming keys must be unique. One full outer join on the key.
    """
    merge = merge or {}
    new = incoming.select(*keys, *[F.col(c).alias(f"new_{c}") for c in (*overwrite, *keep, *merge)], F.lit(True).alias("is_new"))
    joined = current.withColumn("is_old", F.lit(True)).join(new, list(keys), "full_outer")
    here = F.col("is_new").isNotNull()
    out = []
    for c in current.columns:
        old = F.col(c)
        if c in overwrite:
            old = F.when(here, F.col(f"new_{c}")).otherwise(old)
        elif c in keep:
            old = F.coalesce(F.col(f"new_{c}"), old)
        elif c in merge:
            old = F.when(here, merge[c](F.col(c), F.col(f"new_{c}"))).otherwise(old)
        out.append(old.alias(c))
    return joined.select(*out)


def reconcile(current: DataFrame, live: DataFrame, sources: DataFrame, keys: tuple[str, ...] = KEY, where: Column | None = None) -> DataFrame:
    """`current` without rows of the given (successful) sources that are no longer live; `where` limits what may go."""
    may = F.lit(True) if where is None else where
    gone = current.where(may).join(sources.select("source").distinct(), "source", "left_semi").join(live.select(*keys), list(keys), "left_anti").select(*keys)
    return current.join(gone, list(keys), "left_anti")


def rename(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn(column, F.coalesce(table[F.col(column)], F.col(column)))


def expire(df: DataFrame, day: Column, today: str, keep_days: int = 30) -> DataFrame:
    """Rows whose day can't be read stay."""
    return df.where(F.coalesce(F.datediff(F.to_date(F.lit(today)), day) <= keep_days, F.lit(True)))


def crawl_decision(page: Column, added: Column, reached_old: Column, most_pages: int) -> Column:
    return F.when(reached_old | (added == 0), "stop").when(page >= most_pages, "overrun").otherwise("continue")


def pages_to_read(pages: DataFrame, cutoff: str, most_pages: int) -> DataFrame:
    """What a crawl would have read of landed pages (source, page, key, day): new keys of each page, whether its last day is old, and the decision."""
    first = pages.groupBy("source", "key").agg(F.min("page").alias("page"))
    added = first.groupBy("source", "page").agg(F.count("*").alias("added"))
    last = pages.groupBy("source", "page").agg(F.max(F.struct("pos", "day")).alias("last")).select("source", "page", (F.col("last.day") < F.to_date(F.lit(cutoff))).alias("old"))
    x = last.join(added, ["source", "page"], "left").select("source", "page", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("old", F.lit(False)).alias("old"))
    return x.withColumn("decision", crawl_decision(F.col("page"), F.col("added"), F.col("old"), most_pages))


def rotation(rows: DataFrame, seen: DataFrame, limit: int) -> DataFrame:
    """The next `limit` rows to fetch in detail: never fetched ones first, then the oldest."""
    x = rows.join(seen, "id", "left")
    return x.orderBy(F.col("fetched_at").asc_nulls_first(), F.col("id")).limit(limit)


def group_offers(offers: DataFrame, key: Column) -> DataFrame:
    """Offers (title, store, deadline) of one product become one row: its commonest title (the shortest of equals), stores, last deadline."""
    x = offers.withColumn("k", key)
    titles = x.groupBy("k", "title").agg(F.count("*").alias("n")).groupBy("k").agg(F.min(F.struct(-F.col("n"), F.length("title"), F.col("title"))).alias("t"))
    facts = x.groupBy("k").agg(F.countDistinct("store").alias("n_stores"), F.max("deadline").alias("event_date"), F.min("deadline").alias("soonest"))
    return facts.join(titles, "k").select("k", F.col("t.title").alias("title"), "n_stores", "event_date", "soonest")
