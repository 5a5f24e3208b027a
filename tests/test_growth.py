"""What a query's work grows with: texts that are read once, joins that aren't there, and rows that no step multiplies."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from cataloom.functions import stores
from cataloom.llm import components, simhash
from cataloom.operators import findings, matching, resolve, search
from cataloom.schema import ITEM, conform
from cataloom.sources import landing, shared


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prizes_are_parsed_once_for_each_text(spark):
    old = '[{"label":"A","name":"x","resalePrice":7,"resaleText":"t"},{"label":"A","name":"w","resalePrice":8}]'
    new = '[{"label":"A","name":"x"},{"label":"B","name":"y"},{"label":"A","name":"z","resalePrice":1}]'
    rows = spark.createDataFrame([(1, old, new), (2, None, new), (3, old, "broken{"), (4, "[]", new)], "id long, old string, new string")
    merged = rows.select("id", stores.merge_prizes(stores.parse_prizes(F.col("old")), stores.parse_prizes(F.col("new"))).alias("m"))
    got = {r.id: r.m and [(p.label, p.name, p.resalePrice, p.resaleText) for p in r.m] for r in merged.collect()}
    bare = [("A", "x", None, None), ("B", "y", None, None), ("A", "z", 1, None)]
    assert got == {1: [("A", "x", 7, "t"), *bare[1:]], 2: bare, 3: None, 4: bare}
    # new prizes are in two branches of which one is taken
    assert plan(merged).count("from_json") <= 3
    assert plan(rows.select(stores.parse_stores(F.col("old")).alias("s"))).count("from_json") == 1


def test_findings_to_come_are_told_by_each_row_in_one_pass(spark):
    rows = [(1, "予約", "1998-08-05", None), (2, "発売", "1998-08-05", None), (3, "予約", None, "1998年8月4日発売予定"), (4, "予約", "1998-08-01", None), (4, "予約", "1998-08-08", None), (None, "予約", "1998-08-01", "投稿日 1998/8/1"), (6, "予約", "1998-08-09", None)]
    x = conform(spark.createDataFrame(rows, "id long, event_type string, d string, event_date_text string").withColumn("event_date", F.to_date("d")), ITEM)
    found = findings.appearing(x, "1998-08-02", "1998-08-09")
    # of two rows of one id each is told by itself; what is there today, under whatever id, is nothing to come
    assert sorted((r.finding, r.id) for r in found.collect()) == [("date_text_past", 3), ("stale_promise", 1), ("stale_promise", 3), ("stale_promise", 4)]
    assert "Join" not in plan(found)


def test_candidates_of_other_codes_do_not_meet(spark):
    frame = lambda rows: matching.titled(spark.createDataFrame(list(enumerate(rows)), "k long, t string"), F.col("k"), F.col("t"))
    asked, known = [f"red dragon box {c}" for c in ("AB12", "CD34", "plain")], [f"red dragon {c}" for c in ("AB12", "EF56", "GH78", "plain")]
    met = {tuple(r) for r in matching._candidates(frame(asked), frame(known), 0.4).collect()}
    assert met == {(0, 0), (0, 3), (1, 3), *((2, k) for k in range(4))}
    assert {tuple(r) for r in matching._candidates(frame(asked), frame(known), 0.3).collect()} >= {(0, 1), (1, 0)}


def test_equal_titles_are_matched_once(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["red dragon AB12", "blue knight", None, ""] * 50)], "k long, t string")
    catalog = matching.titled(spark.createDataFrame([(7, "red dragon AB12 x"), (8, "blue knights")], "k long, t string"), F.col("k"), F.col("t"))
    got = matching.best_of_rows(rows, F.col("k"), F.col("t"), catalog).collect()
    want = matching.best_matches(matching.titled(rows, F.col("k"), F.col("t")), catalog).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 100
    assert max(r.asDict()["count"] for r in matching.titled(rows, F.col("k"), F.col("t")).groupBy("form").count().collect()) > 1


def test_an_index_keeps_each_title_once(spark):
    rows = spark.createDataFrame([(k, "red dragon") for k in range(200)] + [(200, "blue dragon")], "id long, title string")
    index = search.index(rows)
    assert index.postings().count() <= 60 and "form" not in index.postings().columns
    found = search.found(spark.createDataFrame([("w", "dragon"), ("v", "dragon"), ("x", "blue")], "key string, form string"), index)
    assert found.groupBy("key").count().orderBy("key").collect() == [("v", 201), ("w", 201), ("x", 1)]
    assert search.broken(spark.createDataFrame([("red",)], "word string"), rows, index).count() == 0


def test_a_landed_batch_is_several_files_and_is_read_in_ranges(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "pages")
    page = F.struct(F.concat(F.lit("https://a.example/"), "id").alias("url"), F.lit(None).cast("string").alias("content_type"), F.base64(F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).cast("binary")).alias("content"))
    lines = spark.range(400, numPartitions=4).select((F.col("id") % 2).alias("batch"), F.to_json(page).alias("line"))
    landing.land(lines, folder)
    landing.land(lines.where("batch = 1"), folder)  # again: it takes its own place
    assert sorted(p.name for p in (tmp_path / "pages").iterdir() if p.name[0] != ".") == ["0.jsonl", "1.jsonl"]
    assert len(list((tmp_path / "pages/0.jsonl").glob("part-*"))) == 4
    (tmp_path / "pages/7.jsonl").write_text("\n".join(json.dumps({"url": f"u{k}"}) for k in range(50)))
    monkeypatch.setattr(landing, "RANGE_BYTES", 64)
    reader = landing._Reader(folder)
    parts = reader.partitions({"batch": -1}, {"batch": 7})
    assert len(parts) > 100 and max(p.end - p.start for p in parts) == 64
    got = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert sorted(r["url"] for r in got) == sorted([f"https://a.example/{k}" for k in range(400)] + [f"u{k}" for k in range(50)])
    assert sum(len(r["content"] or b"") for r in got) == sum(k % 97 for k in range(400))


def test_long_names_that_contain_others(spark):
    rng = random.Random(5)
    whole = ["".join(rng.choice("abcdefgh日本") for _ in range(rng.choice([9, 40, 300, 3000]))) for _ in range(40)]
    pieces = [w[i : i + n] for w in whole for n in (3, 30, 31, 35, 200) for i in [rng.randrange(max(1, len(w) - n))]]
    rows = [(k, "s", f"https://s.example/{k % 3}", t) for k, t in enumerate(whole + pieces)]
    x = resolve.with_order(conform(spark.createDataFrame(rows, "id long, source string, url string, title string"), ITEM))
    names = spark.createDataFrame([(k, t) for k, *_, t in rows], "id long, name string")
    kept = {k for k, _, u, t in rows if not any(v == u and t != o and t in o and len(o) >= 8 for _, _, v, o in rows)}
    assert {r.id for r in resolve.contained_names(x, resolve.brief(F.col("title")), names).collect()} == kept and len(kept) < len(rows)


def test_no_step_of_the_resolution_carries_long_titles(spark, monkeypatch):
    """What is written is a few times the titles, however many steps there are."""
    written = []

    def cut(df, name):
        out = shared.cut(df, name)
        texts = [F.coalesce(F.length(c), F.lit(0)) for c in ("title", "name", "name_key") if c in df.columns]
        written.append((name, out.agg(F.max(F.greatest(F.lit(0), F.lit(0), *texts))).first()[0] or 0))
        return out

    monkeypatch.setattr(resolve, "cut", cut)
    rows = [(k, f"s{k % 3}", f"https://s.example/{k % 2}", "".join(random.Random(k % 20).choices("abcdef 日本", k=2000))) for k in range(60)]
    x = conform(spark.createDataFrame(rows, "id long, source string, url string, title string"), ITEM)
    got = resolve.resolve(x, "2024-01-20").select("id", "title").collect()
    assert got and all(r.title == rows[r.id][3] for r in got)
    wide = [name for name, longest in written if longest > 64]
    assert sorted(wide) == ["contained-names", "resolve-keyed"]


def test_components_broadcast_nothing(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(components, "cut", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), shared.cut(df, name))[1])
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31)], "a long, b long")
    assert {tuple(r) for r in components.components(edges).collect()} == {*((k, 0) for k in range(21)), (30, 30), (31, 30)}
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)
    fps = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    assert "Broadcast" not in simhash.postings(fps)._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_names_are_not_dealt_out(spark, monkeypatch):
    """Looking for names inside long ones deals out each name once, and no row for each of its pieces."""
    rng = random.Random(7)
    rows = [(k, "s", f"https://s.example/{k % 4}", "".join(rng.choices("abcdefgh", k=4000))) for k in range(40)]
    rows += [(100 + k, *row[1:3], row[3][900 : 900 + n]) for k, (row, n) in enumerate(zip(rows[:8], (3, 30, 64, 65, 500, 3000, 3999, 4), strict=False))]
    x = resolve.with_order(conform(spark.createDataFrame(rows, "id long, source string, url string, title string"), ITEM))
    plans = []
    monkeypatch.setattr(resolve, "cut", lambda df, name: (plans.append((name, plan(df))), shared.cut(df, name))[1])
    left = {r.id for r in resolve.contained_names(x, F.col("title")).collect()}
    assert left == {k for k, _, u, t in rows if not any(v == u and t != o and t in o for _, _, v, o in rows)} and len(left) < len(rows)
    # of all names, one after another; the only rows that are multiplied are the short records of large pages
    into = next(p for name, p in plans if name == "fold-into")
    assert into.count("Generate") == 1 and "Generate explode(sequence(0" in into


def test_repeated_and_nested_names_go_into_the_longest(spark):
    rows = [(n, "s", "https://s.example/x", "ab" * n) for n in (1, 3, 4, 40, 50, 600)] + [(7, "s", "https://s.example/x", "ba" * 45), (8, "s", "https://s.example/x", "ab" * 45 + "c")]
    x = resolve.with_order(conform(spark.createDataFrame(rows, "id long, source string, url string, title string"), ITEM))
    assert {r.id for r in resolve.contained_names(x, F.col("title")).collect()} == {600, 8}
