"""Clustering, phrases and pieces beside SQL, plain versions and the library, over driver tables, hard rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cataloom.llm import centroids, phrases, pieces, queries
from tests.llm import edges
from tests.rows import same, views

SMALL, MIDDLE = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01"))


@pytest.mark.parametrize("name", ["op11_centroids", "op12_phrases"])
@pytest.mark.parametrize("sf", [SMALL, MIDDLE])
def test_queries_are_their_sql(spark, name, sf):
    con = duckdb.connect()
    views(con, sf)
    assert same(queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.SQL[name]).df()) == ""


# --- op11 --------------------------------------------------------------------------------------------------------------


def test_orchard_finds_the_nearest_and_of_ties_the_first():
    rng = np.random.default_rng(1)
    for _ in range(100):
        c = rng.integers(-3, 4, (rng.integers(1, 20), 3))
        p = rng.integers(-4, 5, (300, 3))
        best, held = centroids.Orchard(c).nearest(p)
        full = ((p[:, None] - c[None]) ** 2).sum(axis=2)
        assert (best == full.argmin(axis=1)).all() and (held == full.min(axis=1)).all()


def test_orchard_ends_lists_beyond_twice_the_distance():
    """Near the first centroid nothing else is measured; a centroid at exactly twice the distance still is, as it may be as close."""
    search = centroids.Orchard(np.array([[0, 0], [1000, 0], [0, 1000]]))
    search.at[1] = 3, 4  # would be the nearest, if it were measured
    assert search.nearest(np.array([[3, 4]]))[0].tolist() == [0]
    assert centroids.Orchard(np.array([[2, 0], [0, 0]])).nearest(np.array([[1, 0]]))[0].tolist() == [0]
    assert centroids.Orchard(np.array([[9, 9], [0, 0], [2, 0]])).nearest(np.array([[1, 0]]))[0].tolist() == [1]


def plain_clusters(rows, k, rounds, dims, scale):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), (r[0] is not None, r[0] or 0), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(near(v)[1], []).append(v)
        c = [tuple(sum(x) // len(of[j]) for x in zip(*of[j], strict=True)) if j in of else x for j, x in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    each = Counter()
    for _, j, d in found:
        each[j] += d
    return Counter((i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found)


def test_clusters_of_hard_rows(spark):
    rng = random.Random(2)
    vector = lambda: [round(rng.uniform(-1, 1), 3) for _ in range(4)]
    rows = [(k, vector()) for k in range(40)] + [(k, [0.0, 0.0, 0.0, 0.0]) for k in range(40, 60)]
    rows += [(5, [0.5, 0.5, 0.5, 0.5]), rows[7], rows[7], (None, vector()), (None, None), (70, [1.0, None, 0.0, 0.0]), (71, [1.0, math.nan, 0.0, 0.0]), (72, [1.0, math.inf, 0.0, 0.0]), (73, [1.0]), (74, []), (75, [-1e6, 1e6, 0.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int")
    for k in (1, 5, 100):
        got = centroids.cluster(frame, k=k, dims=4)
        assert Counter(tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == plain_clusters(rows, k, 3, 4, 64)
    assert centroids.cluster(frame.limit(0), dims=4).count() == 0
    assert centroids.cluster(frame.where("vec_id = 73"), dims=4).count() == 0


# --- op12 --------------------------------------------------------------------------------------------------------------


def plain_phrases(rows, most, least, inside, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for end in ",;:!?\n\x0b\x0c\r":
            text = text.replace(end, ".")
        for piece in text.split("."):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for m in range(1, most + 1):
                for k in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[k : k + m])] += 1
    out = []
    for lang, count in f.items():
        chosen = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in chosen.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    held[p[k : k + m]] = max(held[p[k : k + m]], a)
        scored = []
        for p, a in chosen.items():
            if held[p] and 100 * held[p] >= inside * a:
                continue
            s, _, left, right = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("most", [2, 3, 4])
@pytest.mark.parametrize("budget", [1, 20, 100_000])
def test_phrases_of_few_words(spark, most, budget):
    """Words recur so often that every level of prefixes is extended with the small budgets."""
    rng = random.Random(most)
    pool = ["a", "B", "c", "a-b", "\x01x", "Ünd", "und", ".", ",", "\n", "  ", "\t", "a\x01"]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for _ in range(60)]
    rows += [("en", None), ("en", ""), ("fr", "..."), (None, None), rows[3], rows[3]]
    frame = spark.createDataFrame([(x, t, "x", 1) for x, t in rows], "lang string, text string, f string, phrase int").repartition(5)
    got = phrases.collocations(frame, most=most, least=3, top=40, budget=budget)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain_phrases(rows, most, 3, 50, 40)


def test_prefixes_are_extended_where_they_are_full(spark):
    frame = spark.createDataFrame([("en", "a b c. a b d. a e f. g h i")], "lang string, text string")
    levels, full = phrases.partitioned(phrases.run_counts(frame, 3), 3, 1, 1)
    assert [len(x) for x in full] == [2, 1]  # a and b; a b
    got = {r.leaf: (r.depth, r.c) for r in phrases._leaves(frame, 3, levels, full).collect()}
    assert got == {"a b c": (3, 1), "a b d": (3, 1), "a e f": (2, 1), "b c ": (2, 1), "b d ": (2, 1), "e f ": (1, 1), "g h i": (1, 1), "h i ": (1, 1), "c  ": (1, 1), "d  ": (1, 1), "f  ": (1, 1), "i  ": (1, 1), "  ": (1, 0)}


def test_leaves_end_before_what_is_rare(spark):
    """Of six words that are all frequent: a pair that is rare ends the leaves that hold it."""
    frame = spark.createDataFrame([("en", "a b c. a b c. b c d. a d. d")], "lang string, text string")
    levels, full = phrases.partitioned(phrases.run_counts(frame, 3), 3, 2, 100)
    got = {r.leaf: r.c for r in phrases._leaves(frame, 3, levels, full).collect()}
    assert got == {"a b c": 2, "b c ": 3, "c  ": 3, "a  ": 1, "d  ": 3, "  ": 0}


def test_phrases_of_hard_rows(spark):
    got = phrases.collocations(edges.docs(spark), least=2)
    rows = [(r[2], r[1]) for r in edges.ROWS]
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain_phrases(rows, 3, 2, 50, 2000)
    assert phrases.collocations(edges.docs(spark, [])).count() == 0


def test_scores_beyond_64_bits(spark):
    x = spark.createDataFrame([(4_000_000_000_000, 4_100_000_000_000, 4_000_000_000_001)], "a long, l long, r long")
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731 - as in collocations
    got = x.select((F.lit(1000000).cast("decimal(7,0)") * (wide("a") * wide("a"))).alias("above"), (wide("l") * wide("r")).alias("below")).select(F.expr("above div below")).first()[0]
    assert got == 1000000 * 4_000_000_000_000**2 // (4_100_000_000_000 * 4_000_000_000_001)


# --- op13 --------------------------------------------------------------------------------------------------------------


def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.VOCABULARY))


def test_pieces_are_the_librarys(spark):
    sp = library()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()]
    got = queries.QUERIES["op13_pieces"](spark, MIDDLE)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for d, text in docs:
        ids = sp.encode(text or "")
        want[d, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))] += 1
    assert Counter(tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_pieces_of_made_texts():
    sp, own = library(), pieces.model(public_tokenizers.path(pieces.VOCABULARY))
    rng = random.Random(1)
    signs = " " * 8 + "\n\t▁aabcdeeethhiinorst.,ABé你好😀\x00ἡ0123<>s"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(4000)]
    some = list(own.id)
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(1, 8))) for _ in range(4000)]
    texts += ["a" * n for n in range(80)] + [" " * n for n in range(80)] + ["<s>", "</s> <unk>", "<0x41>"]
    texts += ["".join(rng.choice("abcdehilnorst") for _ in range(60_000)), "z" * 200_000]
    for text, want in zip(texts, sp.encode(texts, num_threads=1), strict=True):
        ids = own.encode(text)
        assert ids == want and own.decode(ids) == sp.decode(ids)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), rng.randrange(3)]) for _ in range(rng.randrange(6))]
        assert own.decode(ids) == sp.decode(ids)


def message(*fields) -> bytes:
    """A protocol buffer message of (number, bytes, float or int)."""
    out = b""
    for number, value in fields:
        kind = 2 if isinstance(value, bytes) else 5 if isinstance(value, float) else 0
        out += bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4])
        if kind == 2:
            out += bytes([len(value)]) + value
        else:
            out += np.float32(value).tobytes() if kind == 5 else bytes([value])
    return out


def test_backtracking_leaves_wrong_places():
    """The longest token comes first, and is taken back where merging goes another way."""
    words = {"ab": -1.0, "bc": -2.0, "abc": -9.0, "cd": -0.5, "abcd": -10.0, "de": -0.1}
    each = [message((1, p.encode()), (2, s)) for p, s in ({c: -50.0 for c in "▁abcde"} | words).items()] + [message((1, f"<0x{b:02X}>".encode()), (3, 6)) for b in range(256)]
    own = pieces.Pieces(message(*[(1, x) for x in each], (2, message((3, 2), (35, 1))), (3, message((3, 0), (4, 0)))))
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice("abcde") for _ in range(rng.randrange(12)))
        assert [t for t, _ in own.tokens(text, own.longest(text))] == own.merged(text)
    assert [t for t, _ in own.tokens("abcde", own.longest("abcde"))] == ["abc", "de"]  # not abcd, the longest that starts there
    assert own.encode("aé") == [own.id["a"], own.byte[0xC3], own.byte[0xA9]]
    with pytest.raises(ValueError):
        pieces.Pieces(message((2, message((3, 1)))))


def test_pieces_of_hard_rows(spark):
    sp = library()
    got = pieces.encode_pieces(edges.docs(spark), public_tokenizers.path(pieces.VOCABULARY))
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == Counter((r[0], tuple(sp.encode(r[1] or ""))) for r in edges.ROWS)
    assert pieces.encode_pieces(edges.docs(spark, []), public_tokenizers.path(pieces.VOCABULARY)).count() == 0
