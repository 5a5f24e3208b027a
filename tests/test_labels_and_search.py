"""Labels read back over three years, the search index beside a scan of all titles, and schemas of snapshots."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from cataloom.functions import clock, labels, stores, text
from cataloom.operators import search, snapshots
from cataloom.sources import sinks

TODAY = "2026-08-16"
DAYS = "sequence(date'2025-06-01', date'2028-06-01')"


def ask(spark, column, rows, schema="t string"):
    frame = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], f"k int, {schema}")
    return [r[0] for r in frame.orderBy("k").select(column).collect()]


def test_labels_of_three_years_are_read_back(spark):
    """Labels with a year are their day; of those without, the day is the one nearest to today."""
    x = spark.range(1).select(F.explode(F.expr(DAYS)).alias("d"))
    d = F.col("d")
    near = F.abs(F.datediff(d, F.to_date(F.lit(TODAY)))) < 182
    for label in (clock.format_long(d), clock.format_short(d, TODAY), clock.format_short_en(d, TODAY)):
        wrong = x.withColumn("label", label).withColumn("got", labels.displayed_day(F.col("label"), TODAY)).where(~F.col("got").eqNullSafe(d))
        left = wrong.where(near | F.col("label").rlike(r"\d{4}")).collect()
        assert not left, left[:3]
        assert x.select(labels.label_problems(label, F.lit(None).cast("string"), TODAY).alias("p"), near.alias("near")).where("near and size(p) > 0").count() == 0


def test_labels_that_are_no_days(spark):
    got = ask(spark, labels.displayed_day(F.col("t"), TODAY), ["2026年9月", "Sep 2026", "2/30(月)", "2026年2月30日", "近日", "発売 8/16", "", None, "8月16日", "Feb 30 (Mon)", "2027/1/5(火)"])
    day = datetime.date
    assert got == [None] * 8 + [day(2026, 8, 16), None, day(2027, 1, 5)]


def test_labels_that_contradict_themselves(spark):
    rows = [("8/16(日)", "🔥 本日"), ("8/16(月)", "本日"), ("8/18(火)", "あと3日"), ("8/18(火)", "あと2日"), ("Aug 17 (Mon)", "Tomorrow"), ("Aug 17 (Tue)", "In 3 days"), ("8/20(木)", "新着"), ("2026年9月", "本日"), (None, None)]
    got = ask(spark, labels.label_problems(F.col("t"), F.col("b"), TODAY), rows, "t string, b string")
    assert got == [[], ["weekday"], ["countdown"], [], [], ["weekday", "countdown"], [], [], []]


def test_times_of_stores_are_read_back_as_they_were_meant(spark):
    """Round trip for each day of three years: a kept time, as its reader saw it up to two days before, gives the same day again."""
    x = spark.range(1).select(F.explode(F.expr(DAYS)).alias("d"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(40))).alias("ahead"))
    kept = F.concat(F.lit("〜"), F.month("d").cast("string"), F.lit("/"), F.dayofmonth("d").cast("string"), F.lit(" 23:59"))
    entry = F.struct(kept.alias("when"), F.col("d").cast("string").alias("at"), F.lit(stores.DEADLINE).alias("kind"))
    read_on = F.date_sub("d", F.col("ahead"))
    x = x.withColumn("kept", kept).withColumn("seen", stores.when_label(entry, read_on)).withColumn("back", labels.unfrozen(F.col("seen"), F.lit(None).cast("string"), read_on.cast("timestamp")))
    assert x.where("seen like '%本日%'").count() == x.where("ahead = 0").count() == x.count() // 4
    assert x.where("back.when <> kept or back.at <> cast(d as string) or back.kind <> '締切' or back.at is null").count() == 0


def test_times_of_stores_by_their_reading(spark):
    at = datetime.datetime(2026, 12, 31, 16, 0)  # the first of January in Japan
    rows = [("〜本日 12:00", None), ("明日〜", None), ("12/30〜", "締切"), ("未定", None), ("", None), (None, "開始"), ("1/3 本日", None)]
    got = ask(spark, labels.unfrozen(F.col("t"), F.col("k2"), F.lit(at.isoformat()).cast("timestamp")), rows, "t string, k2 string")
    assert [tuple(r) for r in got] == [("〜1/1 12:00", "2027-01-01", "締切"), ("1/2〜", "2027-01-02", "開始"), ("12/30〜", "2026-12-30", "締切"), ("未定", None, None), ("", None, None), (None, None, "開始"), ("1/1 本日", "2027-01-01", None)]


TITLES = ["ＨＧ 1/144 ガンダム", "ポケモンカード 151", "ぬい​ぐるみ", "コカ･コーラ", "adidas Samba", "x", "", None, "ポケモンカード 拡張", "ab"]


def test_search_finds_what_a_scan_finds(spark):
    rng = random.Random(4)
    rows = list(enumerate(TITLES + ["".join(rng.choice("abcア") for _ in range(rng.randrange(8))) for _ in range(300)]))
    words = ["hg", "ぬいぐるみ", "コカ・コーラ", "ポケカ", "アディダス", "zzz", "a", "bc", "abc", "アア", "cab", "", "アbcア"]
    postings = search.index(spark.createDataFrame(rows, "id long, title string"))
    got = search.found(search.forms(spark.createDataFrame([(w,) for w in words], "word string")).withColumnRenamed("word", "key"), postings)
    fold = lambda t: text.expanded(t or "", ())[0]
    want = {(w, k) for w in words if w for k, t in rows if any(f in fold(t) for f in text.expanded(w))}
    assert {tuple(r) for r in got.collect()} == want and ("ポケカ", 1) in want and ("アディダス", 4) in want


def test_search_that_is_broken(spark):
    rows = spark.createDataFrame(list(enumerate(TITLES)), "id long, title string")
    postings = search.index(rows.where("id <> 4"))  # as if the index had lost a row
    examples = spark.createDataFrame([("hg",), ("ポケカ",), ("zzz",), ("zzz",), ("アディダス",)], "word string")
    got = {tuple(r) for r in search.broken(examples, rows, postings).collect()}
    assert got == {("example_finds_nothing", "zzz"), ("example_finds_nothing", "アディダス"), ("title_not_found", "4")}
    assert search.broken(examples, rows, search.index(rows)).count() == 1


def test_schemas_of_snapshots(spark, tmp_path):
    folder = str(tmp_path / "snaps")
    assert snapshots.drift(spark, folder).count() == 0
    sinks.write_snapshot(spark.sql("select 1 a, 'x' b, named_struct('p', 1, 'q', array('z')) s, map('k', 1) m"), folder, "2026-08-01")
    assert snapshots.drift(spark, folder).count() == 0
    sinks.write_snapshot(spark.sql("select * from values (1L, named_struct('p', 1, 'q', array(1), 'r', struct(1)), map('k', 'v'), 2), (2L, null, null, 3) as t(a, s, m, c)"), folder, "2026-08-02")
    got = {tuple(r) for r in snapshots.drift(spark, folder).collect()}
    assert got == {("retyped", "a", "int", "bigint", 1, 2), ("lost", "b", "string", None, 1, 2), ("added", "c", None, "int", 1, 2), ("retyped", "m{}", "int", "string", 1, 2), ("retyped", "s.q[]", "string", "int", 1, 2), ("added", "s.r", None, "struct", 1, 2)}
    sinks.write_snapshot(spark.range(3), folder, "2026-08-02")
    assert snapshots.load(spark, folder, "2026-08-02").count() == 3 and snapshots.runs(spark, folder) == ["2026-08-01", "2026-08-02"]
