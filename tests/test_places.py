"""Longest matches beside a scan of the whole table."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cataloom.operators import places


def test_hosts_by_the_most_exact_domain(spark):
    rng = random.Random(2)
    labels = ["a", "b", "shop", "example", "jp", "co"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, n)))
    rows = [(k, host(6)) for k in range(300)] + [(300, None), (301, ""), (302, "a..b"), (303, "SHOP.Example."), (304, ".".join("x" * 1 for _ in range(200)))]
    table = [(host(4), f"v{k}") for k in range(25)] + [("example", "top"), ("example", "other"), ("", "none")]
    got = {r.id: (r.key, r.value) for r in places.by_host(spark.createDataFrame(rows, "id long, host string"), spark.createDataFrame(table, "key string, value string")).collect()}
    want = {}
    for k, h in rows:
        h = (h or "").lower().rstrip(".")
        fit = [d for d, _ in table if d and (h == d or h.endswith("." + d))]
        if fit and ".." not in h and h.count(".") < 127:
            d = max(fit, key=len)
            want[k] = (d, min(v for e, v in table if e == d))
    assert got == want and 303 in got and len(got) > 100


def test_texts_by_the_longest_place(spark):
    rows = [(1, "東京都渋谷区神南"), (2, "東京駅"), (3, "京都市"), (4, "京"), (5, ""), (6, None), (7, "大阪")]
    table = [("東京", "Tokyo"), ("東京都渋谷区", "Shibuya"), ("京都", "Kyoto"), ("渋谷", "no")]
    got = {r.id: r.value for r in places.by_beginning(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(table, "key string, value string")).collect()}
    assert got == {1: "Shibuya", 2: "Tokyo", 3: "Kyoto"}
    assert places.by_beginning(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([], "key string, value string")).count() == 0


def test_places_that_are_written(spark):
    x = spark.createDataFrame([("【東京/原宿】カフェ",), ("【 大阪 ／梅田】店",), ("【限定】店",), ("新宿店",), ("【/x】",), (None,)], "v string")
    assert [r[0] for r in x.select(places.written_place(F.col("v"))).collect()] == ["東京", "大阪", None, None, None, None]


def test_pictures_of_other_shops(spark):
    items = spark.createDataFrame([(1, "amiami", "https://img.amiami.example/1.png"), (2, "blog", "https://img.amiami.example/2.png"), (3, "blog", "https://blog.example/3.png"), (4, "blog", None), (5, None, "https://cdn.hobby.example/5.png")], "id long, source string, image_url string")
    shops = spark.createDataFrame([("amiami.example", "amiami"), ("hobby.example", "hobby")], "key string, value string")
    assert {(r.id, r.shop) for r in places.foreign_images(items, shops).collect()} == {(2, "amiami"), (5, "hobby")}
