"""What became of rows that a page no longer shows, and how snapshots drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock


def excludes_past(page: Column) -> Column:
    return (page != "/premium") & ~page.startswith("/release/")


def removed(before: DataFrame, now: DataFrame) -> DataFrame:
    return before.select("page", "id").join(now.select("page", "id"), ["page", "id"], "left_anti")


def classify_losses(before: DataFrame, now: DataFrame, items: DataFrame, today: str) -> DataFrame:
    """(page, id, cause) of rows gone from pages: gone, expired, merged, moved or unexplained, the first that holds.

    before, now: (page, id). items: (id, event_date, event_date_text, merge_key) of what exists now.
    """
    facts = items.select("id", "event_date", "event_date_text", "merge_key", F.lit(True).alias("exists"))
    shown_keys = now.join(items.select("id", "merge_key"), "id").where("merge_key is not null").select("page", "merge_key", F.lit(True).alias("has_key")).distinct()
    anywhere = now.select("id", F.lit(True).alias("elsewhere")).distinct()
    x = removed(before, now).join(facts, "id", "left").join(shown_keys, ["page", "merge_key"], "left").join(anywhere, "id", "left")
    past = excludes_past(F.col("page")) & (F.coalesce(F.col("event_date") < clock.day(today), F.lit(False)) | clock.is_stale_plan(F.col("event_date"), F.col("event_date_text"), today))
    cause = F.when(F.col("exists").isNull(), "gone").when(past, "expired").when(F.col("has_key"), "merged").when(F.col("elsewhere"), "moved").otherwise("unexplained")
    return x.select("page", "id", cause.alias("cause"))


def reportable(before_n: Column, now_n: Column, unexplained: Column, least: int = 3, share: float = 0.05) -> Column:
    """How much of a page's net loss is to be reported; 0 for small ones."""
    loss = F.least(unexplained, before_n - now_n)
    return F.when((loss >= least) & (loss >= before_n * share), loss).otherwise(0)


def page_report(before: DataFrame, now: DataFrame, items: DataFrame, today: str) -> DataFrame:
    causes = classify_losses(before, now, items, today).groupBy("page").agg(*[F.count_if(F.col("cause") == c).alias(c) for c in ("gone", "expired", "merged", "moved", "unexplained")])
    n = lambda df, name: df.groupBy("page").agg(F.count("*").alias(name))
    x = n(before, "prev").join(n(now, "cur"), "page", "full_outer").join(causes, "page", "left").na.fill(0)
    return x.withColumn("report", reportable(F.col("prev"), F.col("cur"), F.col("unexplained")))


def accumulate(before: DataFrame, today: DataFrame, accepted: bool) -> DataFrame:
    """Running unexplained counts (page, n); accepting starts afresh."""
    if accepted:
        return before.limit(0)
    return before.unionByName(today).groupBy("page").agg(F.sum("n").alias("n"))


def profile(items: DataFrame) -> DataFrame:
    """What a source's rows look like: counts, rates and lengths."""
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return items.groupBy("source").agg(F.count("*").alias("n"), rate(F.col("event_date").isNotNull()).alias("dated"), rate(F.coalesce(F.col("image_url") != "", F.lit(False))).alias("image"), F.avg(F.length("title")).alias("title_len"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, what) of profiles that differ: counts by three in ten, rates by a fifth, title lengths by a quarter."""
    cols = ("n", "dated", "image", "title_len")
    x = old.select("source", *[F.col(c).alias(f"o_{c}") for c in cols]).join(new, "source", "full_outer")
    big = F.col("o_n") >= 5
    rel = lambda c: F.abs(F.col(c) - F.col(f"o_{c}")) / F.nullif(F.col(f"o_{c}"), F.lit(0))
    tests = {
        "appeared": F.col("o_n").isNull(), "vanished": F.col("n").isNull(),
        "count": big & (rel("n") > 0.3), "dated": big & (F.abs(F.col("dated") - F.col("o_dated")) > 0.2),
        "image": big & (F.abs(F.col("image") - F.col("o_image")) > 0.2), "title_len": big & (rel("title_len") > 0.25),
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return x.select("source", F.explode(found).alias("what"))


def health(old: DataFrame, new: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """(source, problem): nothing where there were five, under half, or dates lost. old, new: (source, n, date_rate)."""
    x = old.select("source", F.col("n").alias("o_n"), F.col("date_rate").alias("o_rate")).join(new, "source", "left").na.fill(0, ["n"])
    problem = F.when((F.col("o_n") >= 5) & (F.col("n") == 0), "zero").when((F.col("o_n") >= 5) & (F.col("n") < F.col("o_n") * 0.5), "halved").when((F.col("o_rate") >= 0.5) & (F.col("o_rate") - F.coalesce("date_rate", F.lit(0.0)) > 0.4), "dates")
    return x.where(~F.col("source").isin(*volatile) if volatile else F.lit(True)).select("source", problem.alias("problem")).where("problem is not null")


def fingerprint(items: DataFrame, at: str = "scraped_at") -> DataFrame:
    return items.agg(F.concat_ws(":", F.count("*").cast("string"), F.max(at).cast("string")).alias("fingerprint"))
