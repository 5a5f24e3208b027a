"""Data quality: findings by key, baselines that only tighten, and how many rows each check looked at.

A check is a DataFrame (key, id, detail); all checks are one union, counted together and joined to the baseline once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

LEVELS = ("warn", "error")


def finding(rows: DataFrame, key: str, bad: Column, id_: str = "id", detail: Column | None = None) -> DataFrame:
    return rows.where(bad).select(F.lit(key).alias("key"), F.col(id_).cast("string").alias("id"), (F.lit("") if detail is None else detail).cast("string").alias("detail"))


def repeated(rows: DataFrame, key: str, by: list[str], id_: str = "id", sources: int = 1) -> DataFrame:
    """Groups with several rows (of several sources); id is the group's smallest."""
    g = rows.groupBy(*by).agg(F.min(id_).cast("string").alias("id"), F.count("*").alias("n"), F.countDistinct("source").alias("s"))
    return g.where((F.col("n") > 1) & (F.col("s") >= sources)).select(F.lit(key).alias("key"), "id", F.col("n").cast("string").alias("detail"))


def outside(rows: DataFrame, key: str, column: str, vocabulary: list[str], id_: str = "id") -> DataFrame:
    return finding(rows, key, ~F.coalesce(F.col(column).isin(*vocabulary), F.lit(False)), id_, F.col(column))


def split_groups(rows: DataFrame, key: str, name: Column, label: str, least: int = 10, id_: str = "id") -> DataFrame:
    """One name under several labels."""
    g = rows.where(F.length(name) >= least).groupBy(name.alias("name")).agg(F.countDistinct(label).alias("labels"), F.min(id_).cast("string").alias("id"))
    return g.where("labels > 1").select(F.lit(key).alias("key"), "id", F.col("labels").cast("string").alias("detail"))


def text_checks(rows: DataFrame, column: str = "title", id_: str = "id") -> DataFrame:
    c = F.col(column)
    checks = {
        "text_invisible": text.has_invisible(c),
        "text_broken_char": F.coalesce(c.rlike(r"[�\u0000-\u0008\u000B\u000C\u000E-\u001F]"), F.lit(False)),
        "text_spacing": F.coalesce(c.rlike(r"^[\s　]|[\s　]$|　{3}"), F.lit(False)),
        "unbalanced_bracket": text.unbalanced_brackets(c),
        "title_pipe_residue": F.coalesce(c.contains("|"), F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(k)) for k, bad in checks.items()]))
    return rows.select(F.explode(found).alias("key"), F.col(id_).cast("string").alias("id"), F.lit("").alias("detail"))


def report(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """(key, n, baseline, level): over the baseline is an error whatever the level; keys of the baseline without findings are 0.

    baseline: (key, baseline, level, ratchet).
    """
    n = findings.groupBy("key").agg(F.count("*").alias("n"))
    x = n.join(baseline, "key", "full_outer").select("key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("baseline", F.lit(0)).alias("baseline"), F.coalesce("level", F.lit("warn")).alias("level"), F.coalesce("ratchet", F.lit(True)).alias("ratchet"))
    over = F.col("ratchet") & (F.col("n") > F.col("baseline"))
    return x.select("key", "n", "baseline", F.when(over, "error").when(F.col("n") > 0, F.col("level")).otherwise("ok").alias("level"))


def tightened(baseline: DataFrame, reported: DataFrame) -> DataFrame:
    return baseline.join(reported.select("key", "n"), "key", "left").withColumn("baseline", F.least("baseline", F.coalesce("n", "baseline"))).drop("n")


def coverage(examined: DataFrame, before: DataFrame) -> DataFrame:
    """(key, problem): checks that look at nothing, or at under half of what they did. Both frames: (key, examined)."""
    x = before.select("key", F.col("examined").alias("was")).join(examined, "key", "full_outer").na.fill(0, ["examined", "was"])
    problem = F.when((F.col("examined") == 0) & (F.col("was") > 0), "check_coverage_lost").when(F.col("examined") == 0, "check_idle").when((F.col("was") >= 20) & (F.col("examined") < F.col("was") * 0.5), "check_coverage_shrunk")
    return x.select("key", problem.alias("problem")).where("problem is not null")
