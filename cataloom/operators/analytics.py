"""Reports over the event log and over sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.price import half_up
from ..sources.shared import cut


def top_values(events: DataFrame, name: str, value: Column, limit: int = 20, blank: str = "(不明)") -> DataFrame:
    v = F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(blank))
    return events.where(F.col("event_type") == name).groupBy(v.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def daily(events: DataFrame, at: str = "ts") -> DataFrame:
    return events.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("views"), F.countDistinct("user_id").alias("visitors"))


def top_dimension(events: DataFrame, dimension: Column, limit: int, where: Column | None = None) -> DataFrame:
    rows = events if where is None else events.where(where)
    return rows.groupBy(dimension.alias("dimension")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("visitors")).orderBy(F.desc("n"), "dimension").limit(limit)


def share(part: Column) -> Column:
    """Rounded percentage of rows."""
    return half_up(F.count_if(part) * 100 / F.count("*")).cast("long")


def heavy_days(events: DataFrame, group: Column, least: int, ratio: float, at: str = "ts") -> DataFrame:
    """Days and groups with many views by few visitors."""
    x = events.groupBy(group.alias("grp"), F.to_date(at).alias("day")).agg(F.count("*").alias("views"), F.countDistinct("user_id").alias("visitors"))
    return x.where((F.col("views") >= least) & (F.col("views") >= F.col("visitors") * ratio))


def stale(rows: DataFrame, at: str, today: str, days: int = 3) -> DataFrame:
    x = rows.groupBy("source").agg(F.count("*").alias("n"), F.max(at).alias("newest"))
    return x.withColumn("idle_days", F.datediff(F.to_date(F.lit(today)), F.to_date("newest"))).where(F.col("idle_days") >= days)


def hit_counts(rows: DataFrame, title: Column, words: list[str]) -> DataFrame:
    """(word, n) of titles that hold each word, zeros included; one pass, a sum for each word."""
    sums = rows.agg(*[F.count_if(title.contains(w)).alias(f"w{k}") for k, w in enumerate(words)])
    pairs = F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"w{k}").alias("n")) for k, w in enumerate(words)])
    return sums.select(F.inline(pairs))


def upper_median(rows: DataFrame, value: Column, group: str) -> DataFrame:
    """(group, median): of sorted values that at place n / 2, from 0; by counts of values, so that no group is sorted in one task."""
    from pyspark.sql import Window

    counts = rows.groupBy(group, value.alias("v")).agg(F.count("*").alias("c"))
    part = Window.partitionBy(group)
    run = counts.withColumn("upto", F.sum("c").over(part.orderBy("v"))).withColumn("n", F.sum("c").over(part))
    return run.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(group).agg(F.min("v").alias("median"))


def distinct_titles(rows: DataFrame, title: str, code: str) -> DataFrame:
    """Titles that several rows have get the row's code behind them, so that they can be told apart."""
    often = rows.groupBy(title).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(title).alias("_title"))
    x = rows.join(often, F.col(title) == F.col("_title"), "left")
    both = F.when(F.col("_title").isNotNull() & ~F.col(title).contains(F.col(code)), F.concat(F.col(title), F.lit(" "), F.col(code))).otherwise(F.col(title))
    return x.withColumn(title, both).drop("_title")


def frequent_fragments(fragments: DataFrame, least: int = 3, most: int = 30, limit: int = 15) -> DataFrame:
    """(fragment, n) of the commonest fragments of a length; `fragments` has fragment."""
    x = fragments.where(F.length("fragment").between(least, most)).groupBy("fragment").agg(F.count("*").alias("n"))
    return x.orderBy(F.desc("n"), "fragment").limit(limit)


def price_buckets(rows: DataFrame, noun: Column, price: Column, pos: Column, most: int = 6) -> DataFrame:
    """Least and most of the first nouns, in the order they come."""
    x = rows.groupBy(noun.alias("noun")).agg(F.min(price).alias("low"), F.max(price).alias("high"), F.min(pos).alias("first_pos"))
    return x.orderBy("first_pos").limit(most)


def numbered(rows: DataFrame, group: str, order: str) -> DataFrame:
    """`rows` with rn (from 1, by `order` within a group) and group_rows.

    Rows are dealt in ranges of (group, order), numbered within a range, and ranges start where those before end: a group of
    any size is numbered by many tasks. The ranges are stored, since a number must not change when a task runs again.
    """
    from pyspark.sql import Window

    x = cut(rows.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = x.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    part = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(part.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(group).alias("_group"), F.col("_range").alias("_r"), before.alias("_before"), F.sum("_n").over(part).alias("group_rows"))
    at = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order))
    x = x.withColumn("rn", at).join(sizes, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    return x.withColumn("rn", F.col("rn") + F.col("_before")).drop("_range", "_r", "_group", "_before")


def stride_sample(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """Every (n / k)-th row of each group, k at most."""
    x = numbered(rows, group, order).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("group_rows") / k)))
    return x.where(((F.col("rn") - 1) % F.col("step") == 0) & ((F.col("rn") - 1) / F.col("step") < k)).drop("rn", "step", "group_rows")


def seeded_sample(rows: DataFrame, id_: str, seed: int, n: int) -> DataFrame:
    """n rows that a seed chooses, the same in every run and for every layout: the least digests of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")))
    return rows.orderBy(digest, id_).limit(n)


def baseline_gate(checked: Column, unusable: Column, most: float = 0.2) -> Column:
    """Whether a run read enough to be a baseline: of all it looked at, at most that share was unusable."""
    return F.coalesce(unusable / F.nullif(checked + unusable, F.lit(0)), F.lit(0.0)) <= most


def varied(rows: DataFrame, name: Column, group: Column, order: list[str], limit: int, head: int = 12) -> DataFrame:
    """`rows` with place (1 to `limit`), chosen to be shown side by side: one of each group first, then any, no two names of one beginning.

    Rows are taken in `order`, which tells them apart. A row can only be passed over for a beginning that is taken, so of each
    group its first `limit` beginnings are all that can be chosen: those go through the fold, groups x limit at most.
    """
    at = F.struct(*order)
    firsts = rows.groupBy(group.alias("g"), F.substring(name, 1, head).alias("h")).agg(F.min(at).alias("at"))
    nearest = firsts.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("at"))).where(F.col("rn") <= limit)
    candidates = nearest.agg(F.array_sort(F.collect_list(F.struct("at", "g", "h"))).alias("c"))

    def taken(any_group: bool):
        def step(acc: Column, r: Column) -> Column:
            fresh = ~F.exists(acc, lambda p: p["h"].eqNullSafe(r["h"]))
            if not any_group:
                fresh &= ~F.exists(acc, lambda p: p["g"].eqNullSafe(r["g"]))
            return F.when(fresh & (F.size(acc) < limit), F.concat(acc, F.array(r))).otherwise(acc)

        return step

    first = candidates.select("c", F.aggregate("c", F.slice("c", 1, 0), taken(False)).alias("p"))
    chosen = first.select(F.posexplode(F.aggregate("c", F.col("p"), taken(True))).alias("k", "r")).select((F.col("k") + 1).alias("place"), "r.at.*")
    return rows.join(F.broadcast(chosen), order)  # `limit` rows
