"""Streams that stop and start again, get late and repeated events, and end as the batch queries do."""

from __future__ import annotations

import base64
import datetime
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from cataloom.sources import landing
from cataloom.streaming import events, rotation

DAY0 = datetime.datetime(2024, 1, 1)
EVENT = StructType([StructField("id", LongType())] + [StructField(x, StringType()) for x in ("name", "value", "data", "path")] + [StructField("at", TimestampType())])


def land(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
    return number


def event(k, minute, name="click", value="v"):
    return (k, name, value, "d", "/", DAY0 + datetime.timedelta(minutes=minute))


def test_events_are_there_once_after_stops_and_repeats(spark, tmp_path):
    """Four landings, a stop after each; a batch that ran before the stop is run again; repeats and late events come in between."""
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def go():
        rows = events.accepted(events.read(spark, f"{folder}/landed", EVENT, files_per_trigger=10), ["click", "buy"])
        q = events.write_batches(events.once_each(rows, "id", "at", "10 minutes"), out, check)
        q.awaitTermination(120)
        assert q.exception() is None

    land(spark, folder, 0, [event(1, 0), event(2, 1, "buy", "x" * 300), event(2, 1, "buy", "x" * 300), event(3, 2, "other")], EVENT)
    go()
    land(spark, folder, 1, [event(1, 3), event(4, 30)], EVENT)  # 1 again, within ten minutes of its time
    go()
    written = sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("batch="))
    land(spark, folder, 2, [event(5, 5), event(6, 25), (7, "click", "v", "d", "/", None)], EVENT)  # 5 is late: the watermark stands at 20
    go()
    last = max((tmp_path / "check/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)  # as if the stop had come after the write and before the commit
    go()
    land(spark, folder, 3, [event(6, 26), event(8, 40)], EVENT)
    go()
    got = events.written(spark, out, StructType(list(EVENT)))
    assert sorted((r.id, len(r.value)) for r in got.collect()) == [(1, 1), (2, 200), (4, 1), (6, 1), (8, 1)]
    assert len(written) >= 2


@pytest.mark.parametrize("seed", [1, 2])
def test_fetches_end_as_in_batch_whatever_the_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(25), DAY0 + datetime.timedelta(days=rng.randrange(90), minutes=rng.randrange(1440))) for _ in range(160)]
    rows += [rows[0], rows[0], (100, DAY0), (None, DAY0), (101, None)]
    schema = "id long, fetched_at timestamp"
    rng.shuffle(rows)
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    step = 45
    for k in range(0, len(rows), step):
        land(spark, folder, k, rows[k : k + step], schema)
        stream = events.read(spark, f"{folder}/landed", rotation.schema_of(), files_per_trigger=10)
        q = events.write_batches(rotation.changes(stream), out, check, mode="update")
        q.awaitTermination(180)
        assert q.exception() is None
    newest = max(t for i, t in rows if t and i is not None)
    last = {}
    for i, t in rows:
        if i is not None and t is not None:
            last[i] = max(last.get(i, t), t)
    want = {i: t for i, t in last.items() if t > newest - datetime.timedelta(days=30)}
    got = {r.id: r.fetched_at for r in rotation.fetched(spark, out).collect()}
    assert got == want and 0 < len(want) < len(last)
    assert 100 not in got


def test_windows_close_when_the_watermark_has_passed(spark, tmp_path):
    schema = StructType.fromDDL("event_type string, value double, ts timestamp")
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    at = lambda m: DAY0 + datetime.timedelta(minutes=m)
    for rows in ([("a", 1.0, at(5)), ("a", 2.0, at(59))], [("a", 4.0, at(50)), ("b", 1.0, at(75))], [("a", 9.0, at(30)), ("b", 1.0, at(200))]):
        land(spark, folder, 0, rows, schema)
        q = events.append(events.windowed(events.read(spark, f"{folder}/landed", schema, 10)), out, check)
        q.awaitTermination(120)
    got = {(r.window.start.hour, r.event_type): (r.n, r.total) for r in spark.read.parquet(out).collect()}
    assert got == {(0, "a"): (3, 7.0), (1, "b"): (1, 1.0)}  # the event of 0:30 came after its window had closed
    assert spark.read.parquet(out).where(F.col("n") > 3).count() == 0


def land_pages(folder, number, pages):
    folder.mkdir(exist_ok=True)
    rows = [{"url": u, "content_type": t, "content": c if c is None else base64.b64encode(c).decode()} for u, t, c in pages]
    (folder / f"{number}.jsonl").write_text("\n".join(json.dumps(r) for r in rows))


def test_landed_batches_are_read_once_and_only_new_ones(spark, tmp_path):
    folder, out, check = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "check")

    def go():
        q = events.write_batches(landing.stream(spark, str(folder)), out, check)
        q.awaitTermination(120)
        assert q.exception() is None

    sjis, shop = "text/html; charset=Shift_JIS", "https://www.shop.example/products.json?page=1"
    products = {"products": [{"id": 1, "handle": "one", "title": "ガンダム プラモ", "published_at": "2026-08-01T10:00:00+09:00", "variants": [{"price": "1200.00"}], "images": [{"src": "https://i/1.png"}]}, {"id": 2, "handle": "", "title": "x"}]}
    land_pages(folder, 3, [("https://a.example/x?utm_source=y", sjis, "日本".encode("cp932")), ("https://b.example/", None, '<meta charset="euc-jp">日本'.encode("euc_jp")), (None, None, None)])
    (folder / "notes.txt").write_text("no batch")
    go()
    land_pages(folder, 12, [("https://m.a.example/x/", None, "新しい".encode()), ("https://b.example/bad", "text/html; charset=none", b"\xff ok"), (shop, "application/json", json.dumps(products).encode())])
    products["products"][0]["variants"][0]["price"] = "980"
    land_pages(folder, 20, [(shop, "application/json", json.dumps(products).encode())])
    go()
    go()
    got = spark.read.schema(landing.PAGES).parquet(out)
    texts = got.select("landing", "url", landing.page_text("content", "content_type").alias("t"))
    rows = {(r.landing, r.url): r.t for r in texts.collect()}
    assert len(rows) == 7 == got.count() and rows[3, "https://a.example/x?utm_source=y"] == "日本" and rows[3, "https://b.example/"].endswith("日本") and rows[3, None] is None
    assert rows[12, "https://b.example/bad"] == "� ok"
    newest = {r.page: r.t for r in landing.newest_pages(texts).collect()}
    assert newest["a.example/x"] == "新しい" and len(newest) == 4
    (item,) = landing.shop_items(F.col("t"), texts, F.lit("shop")).collect()
    assert (item.source_id, item.price, item.url, item.image_url, item.genre) == ("one", "980円", "https://www.shop.example/products/one", "https://i/1.png", "プラモ")
    assert item.event_date is None and item.store_listed_at is not None
