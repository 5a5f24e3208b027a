"""Checks of groups beside plain versions that compare all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cataloom.operators import findings


def names(spark, rows):
    return spark.createDataFrame(rows, "id long, code string, words array<string>, codes array<string>")


def conflicts(rows, letters=4):
    kept = [(i, c, {w for w in words or () if len(w) >= letters}) for i, c, words, *_ in rows if c is not None]
    return {c for i, c, a in kept for j, d, b in kept if i != j and c == d and not a & b}


def test_code_conflicts_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    pool = [f"word{k}" for k in range(12)] + ["the", "of"]
    rows = []
    for k in range(300):
        code = rng.choice([None, *[f"c{j}" for j in range(60)]])
        rows.append((k, code, None if rng.random() < 0.02 else [rng.choice(pool) for _ in range(rng.randrange(6, 9) if code and code > "c3" else rng.randrange(4))], []))
    got = findings.code_conflicts(names(spark, rows), F.col("code"), F.col("words"))
    want = conflicts(rows)
    assert sorted(r.code for r in got.collect()) == sorted(want) and 0 < len(want) < 60
    assert findings.code_conflicts(names(spark, []), F.col("code"), F.col("words")).count() == 0


def test_names_without_words_conflict_and_equal_ones_do_not(spark):
    rows = [(1, "a", ["alpha", "beta"], []), (2, "a", ["!!"], []), (3, "b", ["alpha"], []), (4, "b", ["alpha"], []), (5, "c", [], []), (6, "d", None, []), (7, "d", None, []), (8, "e", ["the"], []), (9, "e", ["the"], [])]
    got = findings.code_conflicts(names(spark, rows), F.col("code"), F.col("words"))
    assert sorted(r.code for r in got.collect()) == ["a", "d", "e"] == sorted(conflicts(rows))


def test_codes_of_many_names(spark):
    """10,000 names of one code: with a word that all have, with none, and with one that is missing once."""
    n = 10_000
    x = spark.range(3 * n).select(
        "id",
        F.concat(F.lit("code"), F.floor(F.col("id") / n).cast("string")).alias("code"),
        F.array(F.when(F.col("id") < n, "shared").when((F.col("id") >= 2 * n) & (F.col("id") != 2 * n + 5), "almost"), F.concat(F.lit("name"), F.col("id").cast("string"))).alias("words"),
    )
    got = findings.code_conflicts(x.withColumn("words", F.array_compact("words")), F.col("code"), F.col("words"))
    assert sorted(r.code for r in got.collect()) == ["code1", "code2"]


def keepable(rows):
    out = {}
    for c in {r[1] for r in rows if r[1] is not None}:
        of = sorted((i, set(w or ()), set(k or ())) for i, d, w, k in rows if d == c)
        hubs = [(i, k) for i, w, k in of if all(v <= w for _, v, _ in of)]
        for i, w, k in of:
            out[i] = bool(hubs) and (hubs[0][1] <= k if hubs[0][1] else all(a <= b or b <= a for _, a, _ in of for _, b, _ in of))
    return out


def test_same_products_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for k in range(600):
        full = [f"w{j}" for j in range(5)]
        words = full[: rng.randrange(6)] if rng.random() < 0.8 else rng.sample(full, rng.randrange(6))
        rows.append((k, rng.choice([None, *[f"g{j}" for j in range(150)]]), words, rng.choice([None, [], [], ["op17"], ["op17", "st30"]])))
    got = {r.id: r.keepable for r in findings.same_product(names(spark, rows), F.col("code"), F.col("words"), F.col("codes")).collect()}
    want = keepable(rows)
    assert got == want and 50 < sum(want.values()) < len(want)
    assert findings.same_product(names(spark, []), F.col("code"), F.col("words"), F.col("codes")).count() == 0


def test_zero_adoption_is_silent_where_nobody_counted(spark):
    x = spark.createDataFrame([(1, 5), (0, 0), (0, 7), (0, None), (2, None), (None, 3)], "a int, c int")
    assert [r[0] for r in x.select(findings.zero_adoption(F.col("a"), F.col("c"))).collect()] == ["ok", "nothing_crawled", "nothing_adopted", None, "ok", "nothing_adopted"]
