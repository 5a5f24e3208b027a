"""Every query of the catalog beside its DuckDB SQL, and the few that SQL can't express beside plain versions."""

from __future__ import annotations

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cataloom.functions import clock, price, stores, text
from cataloom.operators import analytics, findings, matching, resolve
from cataloom.plans import catalog_queries, rule_queries
from cataloom.schema import ITEM, conform
from tests.rows import same, views


@pytest.fixture(scope="module")
def con(sf) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    views(con, sf)
    return con


@pytest.mark.parametrize("name", sorted(catalog_queries.SQL))
def test_query_is_its_sql(spark, sf, con, name):
    assert not same(catalog_queries.QUERIES[name](spark, sf).toPandas(), con.sql(catalog_queries.SQL[name]).df())


def test_rules_are_among_the_queries():
    assert {"row_findings", "date_labels"} <= catalog_queries.QUERIES.keys() and rule_queries.query is catalog_queries.query


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "genre", "event_type", "event_date"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def item(spark, rows: list[dict]):
    day = datetime.date(2024, 1, 20)
    names = ("id", "source", "title", "genre", "event_type", "event_date", "url", "market_price", "price")
    schema = "id long, source string, title string, genre string, event_type string, event_date date, url string, market_price int, price string"
    base = {"genre": "g", "event_type": "発売", "event_date": day}
    return conform(spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], schema), ITEM)


def test_fold_takes_over_what_is_missing(spark):
    x = resolve.with_order(item(spark, [{"id": 1, "source": "a", "title": "Figure One"}, {"id": 2, "source": "b", "title": "Figure One", "market_price": 900}, {"id": 3, "source": "b", "title": "Other"}]))
    into = spark.createDataFrame([(2, 1)], "id long, into long")
    got = {r.id: r.market_price for r in resolve.fold(x, into).collect()}
    assert got == {1: 900, 3: None}


def test_targets_need_several_sources(spark):
    x = resolve.with_order(item(spark, [{"id": k, "source": s, "title": t} for k, s, t in ((1, "a", "x"), (2, "b", "x"), (3, "a", "y"), (4, "a", "y"))]))
    got = {tuple(r) for r in resolve.targets(x, F.col("title"), [F.col("id")], sources=2).collect()}
    assert got == {(2, 1)}


def test_keys_of_several_columns_do_not_run_together(spark):
    x = resolve.with_order(item(spark, [{"id": 1, "source": "a", "title": "b|c"}, {"id": 2, "source": "a|b", "title": "c"}, {"id": 3, "source": "a", "title": "b|c"}, {"id": 4, "source": "a"}, {"id": 5, "source": "a"}]))
    assert {r.id for r in resolve.identical_titles(x).collect()} in ({1, 2, 4, 5}, {2, 3, 4, 5})


def test_contained_names_need_one_page(spark):
    rows = [{"id": 1, "title": "Figure One"}, {"id": 2, "title": "Figure One Deluxe"}, {"id": 3, "title": "Figure Two", "url": "https://a.example/x"}, {"id": 4, "title": "New Figure Two Deluxe", "url": "https://a.example/x"}, {"id": 5, "title": "Fig", "url": "https://a.example/x"}]
    x = resolve.with_order(item(spark, [{"source": "a", **r} for r in rows]))
    key = F.regexp_replace(F.lower("title"), "[^a-z0-9]", "")
    assert {r.id for r in resolve.contained_names(x, key).collect()} == {1, 2, 4}


def test_containing_sets_is_all_pairs(spark):
    import random

    rng = random.Random(4)
    sets = [(k, sorted({f"g{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(1, 12))})) for k in range(60)]
    for least in (0.2, 0.5, 0.8, 1.0):
        got = {(r.a, r.b) for r in matching.containing_sets(spark.createDataFrame(sets, "id long, grams array<string>"), least).collect()}
        assert got == {(a, b) for a, x in sets for b, y in sets if a < b and len({*x} & {*y}) / min(len(x), len(y)) >= least}


def test_rules_of_nulls_and_empty_texts(spark):
    x = spark.createDataFrame([(1, None), (2, ""), (3, "）a（b（")], "id int, t string")
    none = F.lit(None).cast("array<struct<name:string,url:string,form:string,at:string>>")
    day = clock.compact_day(F.col("t")).isNull() & clock.slash_day(F.col("t"), 1998, 8).isNull() & stores.ended_summary(none, "1998-08-02").isNull()
    got = x.select("id", text.without_unmatched(F.col("t")), text.looks_truncated(F.col("t")), F.size(text.stale_claims(F.col("t"), {"件": [1]})), stores.lineup(F.col("t")).isNull() | F.lit(False), day, price.first_number(F.col("t")))
    assert [tuple(r)[:4] for r in got.orderBy("id").collect()] == [(1, None, False, 0), (2, "", False, 0), (3, "）a（b", False, 0)]
    assert all(r[5] and r[6] is None for r in got.collect())


def test_varied_picks_are_the_greedy_ones(spark, sf):
    rows = sorted((r.p_size, r.p_partkey, r.p_name[:5], r.p_brand) for r in spark.read.parquet(f"{sf}/part.parquet").select("p_size", "p_partkey", "p_name", "p_brand").collect())
    picked, heads, brands = [], set(), set()
    for every in (False, True):
        for _, id_, head, brand in rows:
            if len(picked) < 40 and head not in heads and (every or brand not in brands):
                picked.append(id_)
                heads.add(head)
                brands.add(brand)
    got = catalog_queries.QUERIES["varied_picks"](spark, sf).orderBy("place").collect()
    assert [(r.place, r.id) for r in got] == list(enumerate(picked, 1)) and len(brands) < len(picked)


@pytest.mark.parametrize("name", ["countdown", "date_buckets", "past_labels", "row_findings", "store_times"])
def test_days_do_not_depend_on_the_sessions_zone(spark, sf, name):
    was, got = spark.conf.get("spark.sql.session.timeZone"), []
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got.append(sorted(map(str, catalog_queries.QUERIES[name](spark, sf).collect())))
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert got[0] and got[0] == got[1] == got[2]


def test_new_rules_take_nulls_and_empty_tables(spark):
    none, empty = F.lit(None).cast("string"), spark.range(0).select("id", F.lit("a").alias("name"))
    row = spark.range(1).select(text.residual(none).alias("r"), text.contrast(none, F.lit("#000000")).alias("c"), text.words_found(none, ["a"], ["b"]).alias("w"), clock.is_recent(none, "2024-01-20").alias("k"), clock.past_notice(none, F.lit(None).cast("date"), none, "2024-01-20").alias("n")).first()
    assert tuple(row) == (None, None, [], True, None)
    assert analytics.varied(empty, F.col("name"), F.col("name"), ["id"], 5).collect() == []
    checks = findings.value_checks("2024-01-20") | findings.claim_checks()
    blank = conform(spark.range(1), ITEM)
    assert [r.finding for r in findings.of_rows(blank, checks).collect()] == []
    assert findings.prize_prices(blank, 0, "2024-01-20").collect() == []
