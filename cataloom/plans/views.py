"""Serving views: parameters in, rows out. Limits that come before resolution are parameters, as they change its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, clock, predicates, stores
from ..operators import resolve as r

def by_day(items: DataFrame) -> DataFrame:
    return items.orderBy(F.col("event_date").asc_nulls_last(), F.col("id").desc())


def first(items: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return items.orderBy(*order).limit(limit)


def filtered(items: DataFrame, today: str, genre: str | None = None, source: str | None = None, query: str | None = None, status: str | None = None, when: str | None = None, dated_only: bool = False) -> DataFrame:
    """The catalog's composite filter. status: now, lottery, reserve or release; when: week or month."""
    x = items.where(predicates.in_scope(F.col("scope")))
    if genre:
        x = x.where(F.col("genre") == genre)
    if source:
        x = x.where(F.col("source") == source)
    if query:
        x = x.where(predicates.title_contains(F.col("title"), query))
    d, kind = F.col("event_date"), F.col("event_type")
    if status == "now":
        return x.where(predicates.is_now(d, kind))
    if status == "lottery":
        x = x.where(predicates.is_lottery(kind, F.col("has_lottery"), F.col("title"), F.col("source")))
    elif status:
        x = x.where(predicates.has_type(kind, status))
    if when:
        return x.where((predicates.this_week if when == "week" else predicates.this_month)(d, today))
    return x.where(predicates.dated(d, today) if dated_only else predicates.upcoming(d, today))


def catalog(items: DataFrame, today: str, raw_limit: int = 5000, recent: bool = False, **filters) -> DataFrame:
    order = [F.col("id").desc()] if recent else [F.col("event_date").asc_nulls_last(), F.col("id").desc()]
    rows = r.resolve(first(filtered(items, today, **filters), order, raw_limit), today)
    return rows.orderBy(*order)


def genre_page(items: DataFrame, today: str, genre: str, raw_limit: int = 1500) -> DataFrame:
    return catalog(items, today, raw_limit, genre=genre)


def lottery_page(items: DataFrame, today: str, raw_limit: int = 1000, limit: int = 300) -> DataFrame:
    return catalog(items, today, raw_limit, status="lottery").limit(limit)


def by_listing() -> list[Column]:
    return [F.col("store_listed_at").desc_nulls_last(), F.col("id").desc()]


def abroad_rows(items: DataFrame, source: str, scope: str = "en", raw_limit: int = 4000) -> DataFrame:
    return first(items.where((F.col("scope") == scope) & (F.col("source") == source)), by_listing(), raw_limit)


def abroad(items: DataFrame, today: str, source: str, scope: str = "en", raw_limit: int = 4000) -> DataFrame:
    return r.resolve(abroad_rows(items, source, scope, raw_limit), today).orderBy(*by_listing())


def all_pages(*pages: DataFrame) -> DataFrame:
    """Rows of all pages, each id once."""
    out = pages[0].select("id")
    for p in pages[1:]:
        out = out.unionByName(p.select("id"))
    return out.distinct()


def month_page(items: DataFrame, today: str, month: str, raw_limit: int = 600, spill: int = 200, limit: int = 300) -> DataFrame:
    """Items of a month (yyyy-MM) by their own day, and those of the next days whose stores open in it; two limits, one union."""
    start = F.to_date(F.lit(f"{month}-01"))
    end = F.add_months(start, 1)
    d = F.col("event_date")
    x = items.where(predicates.in_scope(F.col("scope")))
    inside = first(x.where((d >= start) & (d < end)), [d.asc(), F.col("id").desc()], raw_limit)
    later = first(x.where((d >= end) & (d < F.date_add(end, clock.MAX_PERIOD_DAYS)) & F.col("stores").isNotNull()), [d.asc(), F.col("id").desc()], spill)
    p = clock.period(d, stores.store_days(stores.parse_stores(F.col("stores"))))
    rows = inside.unionByName(later).where(clock.overlaps(p, start, end))
    return by_day(r.resolve(rows, today)).limit(limit)


def months(items: DataFrame, today: str, days: Column) -> DataFrame:
    """Months from the current one on that items have days in; a period adds its months, not its days."""
    p = clock.period(F.col("event_date"), days)
    x = items.select(p.alias("p")).where("p is not null").select(F.explode(F.sequence(F.trunc(F.col("p.start"), "MM"), F.trunc(F.col("p.end"), "MM"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return x.where(F.col("month") >= F.trunc(clock.day(today), "MM")).groupBy("month").agg(F.count("*").alias("n"))


def genres_in_order(items: DataFrame, vocabulary: list[str]) -> DataFrame:
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, vocabulary)), F.col("genre")), F.lit(0))
    x = items.groupBy("genre").agg(F.count("*").alias("n"))
    return x.select("genre", "n", F.when(rank == 0, 99).otherwise(rank).cast("int").alias("place")).orderBy("place", "genre")


def facets(items: DataFrame, today: str, vocabulary: list[str], **filters) -> DataFrame:
    """Counts of each genre under all filters but the genre's own, zeros included."""
    counts = filtered(items, today, **filters).groupBy("genre").agg(F.count("*").alias("n"))
    every = items.sparkSession.createDataFrame([(g,) for g in vocabulary], "genre string")
    return every.join(counts, "genre", "left").select("genre", F.coalesce("n", F.lit(0)).alias("n"))


def buckets(items: DataFrame, today: str) -> DataFrame:
    return items.withColumn("bucket", clock.date_bucket(F.col("event_date"), today))


def card(items: DataFrame) -> DataFrame:
    """What goes to browsers: no addresses and sources; whether it is a lottery and online."""
    lottery = predicates.is_lottery(F.col("event_type"), F.col("has_lottery"), F.col("title"), F.col("source"))
    hidden = {"url", "image_url", "source", "source_id", "official_url"}
    return items.withColumn("lottery", lottery).drop(*hidden)


def calendar(items: DataFrame, month: str) -> DataFrame:
    """A cell for each day of a month with its items, and blanks before and after to whole weeks from Sunday."""
    spark = items.sparkSession
    start = F.to_date(F.lit(f"{month}-01"))
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(start, F.dayofweek(start) - 1), F.date_add(F.last_day(start), 7 - F.dayofweek(F.last_day(start))))).alias("day"))
    n = items.where(F.trunc("event_date", "MM") == start).groupBy(F.col("event_date").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select("day", (F.trunc("day", "MM") == start).alias("in_month"), F.coalesce("n", F.lit(0)).alias("n"))


def related(items: DataFrame, franchises: DataFrame, id_: int, limit: int = 8) -> DataFrame:
    """Items that share a franchise word with one item, then of its genre, without itself; the soonest first."""
    own = items.where(F.col("id") == id_).limit(1)
    words = own.select("title").join(franchises, F.contains("title", "word")).select("word")  # one item's words
    x = items.where(F.col("id") != id_)
    near = x.join(words, F.contains(F.col("title"), F.col("word")), "left_semi").withColumn("tier", F.lit(0))
    fill = x.join(own.select("genre"), "genre", "left_semi").join(near.select("id"), "id", "left_anti").withColumn("tier", F.lit(1))
    return near.unionByName(fill, allowMissingColumns=True).orderBy("tier", F.col("event_date").asc_nulls_last(), F.col("id").desc()).limit(limit)


CARDS = "トレカ"


def card_games(items: DataFrame, today: str, raw: bool = True) -> DataFrame:
    """Upcoming card products, after the resolution (or as they are), with the games each belongs to."""
    x = filtered(items, today, genre=CARDS)
    x = x if raw else r.resolve(x, today)
    return x.withColumn("games", names.card_games(F.col("source"), F.col("sub_genre"), F.col("title")))


def card_game_counts(items: DataFrame, today: str, raw: bool = False) -> DataFrame:
    """(label, n) of the card games with upcoming rows, in the order of display; a row counts for each of its games."""
    n = card_games(items, today, raw).select(F.explode("games").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*[F.lit(label) for label, *_ in names.CARD_GAMES]), F.col("label"))
    return n.orderBy(place).select("label", "n")


def card_game_page(items: DataFrame, today: str, label: str, raw: bool = False) -> DataFrame:
    """One game's upcoming rows, the soonest first; none for an unknown label."""
    return card_games(items, today, raw).where(F.array_contains("games", label)).drop("games").orderBy(F.col("event_date").asc_nulls_last(), F.col("id").desc())
