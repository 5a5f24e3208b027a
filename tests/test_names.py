"""Names of works, card games and the matching of titles, beside plain versions that look at every name and every pair."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cataloom.functions import names, text
from cataloom.operators import matching
from cataloom.plans import views
from cataloom.schema import ITEM, conform


def ask(spark, column, rows, schema="t string"):
    frame = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], f"k int, {schema}")
    return [r[0] for r in frame.orderBy("k").select(column).collect()]


TITLES = [
    "ONE PIECEカードゲーム ブースターパック OP-17",
    "ポケモンカードゲーム 拡張パック ストームエメラルダ",
    "ポケカ スターターデッキ",
    "東方project 人形",
    "東方Project フィギュア",
    "劇場版 魔法少女まどか☆マギカ 一番くじ",
    "学園アイドルマスター 缶バッジ",
    "EVANGELION 初号機 DIGIMON",
    "Evangelion",
    "ジョジョの奇妙な冒険 コナン",
    "Re：ゼロから始める",
    "",
    None,
    "なにもない",
]


def test_works_of_titles(spark):
    got = ask(spark, names.works_in(F.col("t")), TITLES)
    want = [[work for work, *own in names.WORKS if any(n in (t or "") for n in own)] for t in TITLES]
    assert got == want and ["名探偵コナン" in w for w in got].count(True) == 1
    related = ask(spark, names.all_names(names.works_in(F.col("t"))), TITLES)
    assert related == [list(dict.fromkeys(n for g in names.WORKS if g[0] in w for n in g)) for w in want]


def test_works_of_made_titles(spark):
    rng = random.Random(3)
    pool = [n for w in names.WORKS for n in w] + [n.lower() for w in names.WORKS for n in w] + [" ", "ー", "x", "☆", "ポケ", "モン"]
    titles = ["".join(rng.choice(pool)[rng.randrange(2) :] for _ in range(rng.randrange(6))) for _ in range(800)]
    got = ask(spark, names.works_in(F.col("t")), titles)
    assert got == [[work for work, *own in names.WORKS if any(n in t for n in own)] for t in titles]


def test_card_games(spark):
    """By source, kind or title; words with borders; several at once."""
    rows = [
        ("pokemoncard", None, "デッキ"),
        ("x", "ポケモン", ""),
        ("x", None, "ワンピース カード"),
        ("x", None, "ワンピース　カード"),
        ("x", None, "one piece カード"),
        ("x", "One Piece", None),
        ("x", None, "Gundam Card と ガンダム"),
        ("x", "ガンダム", "遊☆戯☆王"),
        ("x", None, "DM24 ブースター"),
        ("x", None, "ADM24 ブースター DMX"),
        ("x", None, "dm1"),
        ("x", None, "mtg 新弾"),
        ("x", None, "MTGX _MTG"),
        ("x", None, "マジック：ザ・ギャザリング"),
        ("x", "マジック", "デジモンとコナンカード"),
        (None, None, None),
    ]
    want = [["ポケカ"], ["ポケカ"], ["ワンピースカード"], ["ワンピースカード"], ["ワンピースカード"], ["ワンピースカード"], ["ガンダムカード"], ["ガンダムカード", "遊戯王"], ["デュエマ"], [], ["デュエマ"], ["MTG"], [], ["MTG"], ["MTG", "名探偵コナンカード", "デジモンカード"], []]
    assert ask(spark, names.card_games(F.col("s"), F.col("k2"), F.col("t")), rows, "s string, k2 string, t string") == want


def test_search_by_other_names(spark):
    cases = [("ポケカ", "ポケモンカード 151", True), ("ポケカ", "ポケット", False), ("アディダス", "adidas Samba", True), ("ADIDAS", "アディダス サンバ", True), ("ワンピカード", "ONE PIECEカード", True), ("ｎｉｋｅ", "ナイキ エア", True), ("hg", "ＨＧ 1/144", True), ("", "x", True)]
    for query, title, want in cases:
        assert ask(spark, text.matches_query(text.search_form(F.col("t")), query), [title]) == [want], (query, title)


# --- matching ----------------------------------------------------------------------------------------------------------


def plain_score(a, b):
    x, y = (names.facts_of(t, names.finder(names.WORK_NAMES)) for t in (a, b))

    def alike(p, q):
        if not p or not q:
            return 0.0
        if len(p) < 2 or len(q) < 2:
            return float(p == q)
        g, h = (Counter(v[k : k + 2] for k in range(len(v) - 1)) for v in (p, q))
        return 2 * sum((g & h).values()) / (sum(g.values()) + sum(h.values()))

    whole = alike(x["form"], y["form"])
    if x["codes"] and y["codes"]:
        return max(whole, 0.85) if set(x["codes"]) & set(y["codes"]) else min(whole, 0.35)
    if set(x["works"]) & set(y["works"]) and len(x["rest"]) >= 2 and len(y["rest"]) >= 2:
        return alike(x["rest"], y["rest"])
    return whole


def made(rng, n):
    works = ["ワンピース", "ポケモン", "ガンダム", "NIKKE", "ちいかわ", ""]
    rest = ["ブースターパック", "ストームエメラルダ", "君臨のヘッドライナー", "A賞", "フィギュア", "アクリルスタンド", "第2弾", "BOX", "限定", "ぬいぐるみ"]
    codes = ["OP-17", "OP-16", "GD04", "SV11B", "", "", "", "VOL12"]
    return [" ".join(x for x in (rng.choice(works), *rng.sample(rest, rng.randrange(4)), rng.choice(codes)) if x) for _ in range(n)] + ["", None, "x", "ー"]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_best_matches_are_those_of_all_pairs(spark, threshold):
    rng = random.Random(9)
    asked, known = made(rng, 120), made(rng, 150)
    frame = lambda rows: matching.titled(spark.createDataFrame(list(enumerate(rows)), "k long, t string"), F.col("k"), F.col("t"))
    got = {r.query_id: (r.item_id, round(r.score, 9)) for r in matching.best_matches(frame(asked), frame(known), threshold).collect()}
    want, form = {}, lambda t: names.facts_of(t, names.finder(names.WORK_NAMES))["form"]
    for k, a in enumerate(asked):
        best = max(((plain_score(a, b), bool(form(a)) and form(a) == form(b), -j) for j, b in enumerate(known)))
        if best[0] >= threshold:
            want[k] = (-best[2], round(best[0], 9))
    assert got == want and len(want) > 50


def test_matches_of_smaller_units(spark):
    frame = lambda rows: matching.titled(spark.createDataFrame(list(enumerate(rows)), "k long, t string"), F.col("k"), F.col("t"))
    got = matching.best_matches(frame(["強い竜 BOX", "強い竜"]), frame(["強い竜 カートン", "強い竜 BOX", "強い竜"]), 0.3, units=True).collect()
    assert {r.query_id: r.item_id for r in got} == {0: 1, 1: 2}
    assert matching.best_matches(frame([]), frame(["a"])).count() == 0 == matching.best_matches(frame(["a b"]), frame([])).count()


def test_common_keys_are_split(spark):
    """A thousand items of one code: pairs are found in many parts, each once."""
    known = spark.range(3000).select(F.col("id").alias("item_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"))
    asked = spark.createDataFrame([(1, "hot"), (2, "k4"), (3, "none")], "query_id long, key string")
    got = matching._met(asked, known)
    assert got.count() == 1001 == got.distinct().count()


def test_forms_are_those_of_the_native_rules(spark):
    titles = [t for t in TITLES if t] + ["Ｏｐ－１７　『限定』 (再販) no12 vol.3 ABCDE123XYZ"]
    rows = ask(spark, F.struct(names.title_facts(F.col("t")).alias("f"), text.title_form(F.col("t")).alias("form"), text.model_codes(F.col("t")).alias("codes")), titles)
    assert [(r.f.form, r.f.codes) for r in rows] == [(r.form, r.codes) for r in rows]
    assert all(re.fullmatch(r"\S*", r.f.rest) for r in rows)


def test_pages_of_card_games(spark):
    """Counts in the order of display, rows that belong to two games, and what isn't upcoming or of another scope."""
    rows = [
        (1, "a", "MTG 新弾", "2026-09-01", None, None),
        (2, "a", "ポケカ 新弾", None, None, None),
        (3, "a", "ポケカ と デジモン", "2026-08-20", None, None),
        (4, "a", "ポケカ 旧弾", "2026-08-01", None, None),
        (5, "a", "ポケカ abroad", "2026-09-01", "en", None),
        (6, "pokemoncard", "スリーブ", "2026-08-16", "jp", "x"),
        (7, "a", "なにか", "2026-09-01", None, None),
    ]
    frame = spark.createDataFrame(rows, "id long, source string, title string, event_date string, scope string, sub_genre string").withColumn("genre", F.lit(views.CARDS)).withColumn("event_date", F.to_date("event_date"))
    x = conform(frame, ITEM)
    assert [tuple(r) for r in views.card_game_counts(x, "2026-08-16", raw=True).collect()] == [("ポケカ", 3), ("MTG", 1), ("デジモンカード", 1)]
    assert [r.id for r in views.card_game_page(x, "2026-08-16", "ポケカ", raw=True).collect()] == [6, 3, 2]
    assert [r.id for r in views.card_game_page(x, "2026-08-16", "ポケカ").collect()] == [6, 3, 2]
    assert views.card_game_page(x, "2026-08-16", "none", raw=True).count() == 0
