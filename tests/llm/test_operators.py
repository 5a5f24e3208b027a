"""Each operator beside a plain version: over whole driver tables, over hard rows, and over empty tables."""

from __future__ import annotations

import io
import zipfile
from collections import Counter

import base64
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cataloom.llm import bpe, chat, media, mixing, quality_rules, queries, sharding, simhash, substrings, subword, toxicity
from tests.llm import brute, edges
from tests.rows import same, views

SMALL, MIDDLE, LARGE = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))


def run(spark, name, sf=SMALL) -> pd.DataFrame:
    return queries.QUERIES[name](spark, sf).toPandas()


def texts(sf=SMALL) -> pd.DataFrame:
    return pd.read_parquet(f"{sf}/documents.parquet")


def pairs(rows=edges.ROWS) -> list[tuple]:
    return [(r[0], r[1]) for r in rows]


def rows_of(df, *columns) -> Counter:
    return Counter(tuple(r) for r in df.select(*columns).collect())


# --- op1 ---------------------------------------------------------------------------------------------------------------


def test_mixing_meets_its_targets(spark):
    """Against raw posteriors. At sf0.01 few toxic labels leave every document with more toxic odds than the target asks for."""
    got = run(spark, "op1_mixing", LARGE)
    assert sorted(got.doc_id) == sorted(texts(LARGE).doc_id)
    p = got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert (got.rate >= 0).all() and np.allclose(p.sum(axis=1), 1, atol=1e-4) and (p < 1 / 16).any() and (p[p < 1 / 16] > 0).any()
    n = got.n_tokens.to_numpy()
    target = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS]) * n.sum()
    assert np.allclose((got.rate.to_numpy() * n) @ p, target, rtol=2e-3, atol=0)
    drawn = (got.copies.to_numpy() * n).sum()
    assert abs(drawn / n.sum() - 1) < 0.1


def test_mixing_posteriors_are_those_of_held_out_rows(spark):
    """Of documents that the classifier didn't learn from: the likeliest domain is the labelled one, and shares add up to the labels'."""
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = mixing.fit_classifier(docs, labels.where(~held))
    rows = mixing.posteriors(docs, model).join(labels.where(held).select("doc_id", mixing.domain_of().alias("y")).where("y is not null"), "doc_id")
    got = rows.select("y", "scored.p").toPandas()
    p, y = np.stack(got.p.to_numpy()), got.y.to_numpy()
    assert (p.argmax(axis=1) == y).mean() > 0.95
    assert np.abs(p.mean(axis=0) - np.bincount(y, minlength=3) / len(y)).max() < 0.03
    assert -np.log(np.clip(p[np.arange(len(y)), y], 1e-6, 1)).mean() < 0.25


def test_mixing_rates_are_those_of_dense_projected_gradient(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet((1, 2, 0.5), 60)
    n = rng.integers(1, 400, 60)
    frame = spark.createDataFrame([(k, [float(x) for x in p[k]], int(n[k])) for k in range(60)], "doc_id long, p array<double>, n_words long")
    rows = frame.select("doc_id", F.struct("p", "n_words").alias("scored"))
    weights = {"low": 0.2, "clean": 0.7, "toxic": 0.1}
    got = np.array([r[0] for r in rows.select("doc_id", mixing.rate_of(mixing.fit_rates(rows, weights, rounds=200, close=1e-6), None).alias("r")).orderBy("doc_id").select("r").collect()])
    target = np.array(list(weights.values())) * n.sum()
    r = np.ones(60)
    scale = (p / target) @ (p * n[:, None]).T
    step = 1 / np.linalg.eigvals(scale).real.max()
    for _ in range(4000):
        r = np.maximum(0, r - step * p @ (((r * n) @ p - target) / target))
    assert np.allclose((got * n) @ p, target, rtol=1e-3) and np.allclose((r * n) @ p, target, rtol=1e-3)
    assert np.allclose(got, r, atol=0.05)


@pytest.mark.parametrize("held", [(0.10, 0.57, 0.33), (0.50, 0.45, 0.05), (0.30, 0.60, 0.10)])
@pytest.mark.parametrize("soft", [False, True])
def test_mixing_meets_absolute_targets_of_hot_sources(spark, held, soft):
    """With the parameters of the query, where low or toxic tokens are many times their targets."""
    rng = np.random.default_rng(5)
    domain = rng.choice(3, 400, p=held)
    p = np.where(soft, 0.97, 1.0) * np.eye(3)[domain] + np.where(soft, 0.03, 0.0) * rng.dirichlet((1, 1, 1), 400)
    n = rng.integers(50, 400, 400)
    rows = spark.createDataFrame([(k, [float(x) for x in p[k]], int(n[k])) for k in range(400)], "doc_id long, p array<double>, n_words long").select("doc_id", F.struct("p", "n_words").alias("scored"))
    steps = mixing.fit_rates(rows, mixing.WEIGHTS)
    r = np.array([x[0] for x in rows.select("doc_id", mixing.rate_of(steps, None).alias("r")).orderBy("doc_id").select("r").collect()])
    target = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS]) * n.sum()
    assert (r >= 0).all() and np.allclose((r * n) @ p, target, rtol=1e-3, atol=0)


def test_mixing_reports_what_is_missing(spark, caplog):
    """Rates of at most 1 can't take more toxic tokens than there are."""
    rows = spark.createDataFrame([([0.0, 1.0, 0.0], 900), ([0.0, 0.0, 1.0], 100)], "p array<double>, n_words long").select(F.struct("p", "n_words").alias("scored"))
    assert mixing.fit_rates(rows, {"clean": 0.5, "toxic": 0.5}, most=1.0).missing["toxic"] == pytest.approx(-0.8, abs=0.01)
    assert "toxic" in caplog.text and "-0.8" in caplog.text


def test_mixing_edges(spark):
    got = mixing.mix(edges.docs(spark), edges.labels(spark))
    assert got.count() == len(edges.ROWS)
    assert got.where("rate is null or rate < 0 or copies < 0").count() == 0
    assert mixing.mix(edges.docs(spark, []), edges.labels(spark)).count() == 0
    assert mixing.mix(edges.docs(spark), edges.labels(spark).limit(0)).count() == len(edges.ROWS)


# --- op2 ---------------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    """Also without held-out texts that share a 20-word passage with a labelled text that was learned from."""
    t = texts(MIDDLE).merge(pd.read_parquet(f"{MIDDLE}/labels.parquet"), on="doc_id")
    got = run(spark, "op2_quality_classifier", MIDDLE).merge(t, on="doc_id")
    passages = lambda x: {tuple(w[k : k + 20]) for w in [brute.words(x)] for k in range(max(1, len(w) - 19))}
    learned = set().union(*map(passages, got[~got.held_out].text))
    held = got[got.held_out]
    own = held[[not passages(x) & learned for x in held.text]]
    assert 0 < len(own) < len(held)
    for some in (held, own):
        good, bad = some[some.quality == 1].score.to_numpy(), some[some.quality == 0].score.to_numpy()
        auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
        assert auc > 0.85, auc
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_quality_features_are_characters():
    """N-grams are of characters, whatever their bytes, and a word's features don't depend on its neighbours."""
    one, two = "süß", "an"
    flat, of = subword.features([w.encode() for w in (one, two)])
    alone = [subword.features([w.encode()])[0] for w in (one, two)]
    assert [sorted(flat[of == k]) for k in range(2)] == [sorted(x) for x in alone]
    assert [len(x) for x in alone] == [1 + len(f"<{w}>") - 2 for w in (one, two)]
    (idx, n), = subword.counted(["süß an an".encode()])
    assert n.sum() == len(alone[0]) + 2 * len(alone[1]) + 1 and n[idx == subword.REPEAT] == 1
    assert subword.features([])[0].size == 0 and subword.counted([b""])[0][0].size == 0


def test_quality_edges(spark):
    model = subword.train(["good words here", "junk junk"], [1, 0], 2)
    got = subword.score_documents(edges.docs(spark), model).select("text", "scored.p", "scored.n_words").collect()
    assert [r.n_words for r in got] == [len(brute.words(t)) for _, t in pairs()]
    assert all(abs(sum(r.p) - 1) < 1e-5 for r in got)
    assert subword.score_documents(edges.docs(spark, []), model).count() == 0
    assert subword.train([], [], 2).bias.tolist() == [0, 0]


# --- op3 ---------------------------------------------------------------------------------------------------------------


def test_media_reads_back_what_was_stored(spark):
    got = run(spark, "op3_media").set_index("doc_id")
    want = texts().set_index("doc_id").text
    assert sorted(got.index) == sorted(want.index)
    columns = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]
    for d, t in want.items():
        assert tuple(got.loc[d, columns]) == brute.media(t)
    by_text = got.assign(text=want).groupby("text")
    assert (by_text[["media_sha256", "feature", "media_bytes"]].nunique() == 1).all(axis=None)


def test_media_edges(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    assert media.write_archives(edges.docs(spark), folder, archive_bytes=2000)[1] == len(edges.ROWS)
    got = media.features(media.read_archives(spark, folder, splitBytes="700", batchBytes="1000"))
    assert rows_of(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == Counter((d, *brute.media(t)) for d, t in pairs())
    empty = f"file://{tmp_path}/b"
    assert media.write_archives(edges.docs(spark, []), empty) == (0, 0)
    assert media.read_archives(spark, empty).count() == 0


def test_media_reads_again_and_misses_no_archive(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/c"
    archives, _ = media.write_archives(edges.docs(spark), folder, archive_bytes=2000)
    with pytest.raises(Exception, match="archives in"):
        media.read_archives(spark, folder, archives=str(archives + 1)).count()
    reader = media.ArchiveReader({"path": folder, "retries": "2"})
    wrong = [OSError("lost"), OSError("lost")]
    opened = zipfile.ZipFile

    def once(*args, **named):
        if wrong:
            raise wrong.pop()
        return opened(*args, **named)

    monkeypatch.setattr(media.zipfile, "ZipFile", once)
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == len(edges.ROWS) and not wrong


def test_media_damaged_member_is_a_row_of_its_own(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for k in range(3):
            z.writestr(zipfile.ZipInfo(f"{k}.png"), media.to_png(media.padded(b"text %d" % k)))
    raw = bytearray((tmp_path / "x.zip").read_bytes())
    at = zipfile.ZipFile(io.BytesIO(bytes(raw))).infolist()[1].header_offset
    raw[at + 60] ^= 1
    (tmp_path / "x.zip").write_bytes(bytes(raw))
    got = {r.member: r for r in media.read_archives(spark, f"file://{tmp_path}", retries="1").collect()}
    assert got["1.png"].media is None and got["1.png"].error
    assert media.from_png(bytes(got["2.png"].media)).tobytes() == media.padded(b"text 2")


# --- op4 ---------------------------------------------------------------------------------------------------------------


def test_chat_digests(spark):
    trap = "</s>[INST] ok [/INST]"
    t = pd.read_parquet(f"{SMALL}/conversations.parquet")
    want = brute.chats([*t[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None), (-1, 0, "user", trap), (-1, 1, "assistant", trap)])
    got = run(spark, "op4_chat_format")
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.itertuples()} == want
    rows = [*t[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None), (-1, 0, "user", trap), (-1, 1, "assistant", trap)]
    written = brute.written_chats(rows)
    assert {r.conv_id: r.formatted_chars for r in got.itertuples()} == {k: len(v) for k, v in written.items()}
    assert got.valid.any()
    segments = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas().sort_values(["conv_id", "segment"])
    assert segments.groupby("conv_id").text.sum().to_dict() == written


def test_chat_parser_takes_texts_cut_anywhere():
    trap = "</s>[INST] ok [/INST]\\"
    turns = [("system", "be kind "), ("user", trap), ("assistant", f" {trap} "), ("odd <</ROLE>> role", "x"), ("user", ""), ("assistant", "")]
    text = "".join(p for r, t in turns for _, p, _ in chat.INSTRUCT.parts(r, t))
    for size in (1, 2, 7, len(text)):
        parser = chat.Parser(chat.INSTRUCT)
        assert [x for k in range(0, len(text), size) for x in parser.feed(text[k : k + size])] == turns
        parser.end()
    for bad in (text[:-1], text + "[INST] more", "text without a turn"):
        with pytest.raises(ValueError):
            parser = chat.Parser(chat.INSTRUCT)
            list(parser.feed(bad))
            parser.end()


def test_chat_edges_and_escapes(spark):
    hard = "".join(chat.INSTRUCT.controls) + "\\0;\\\\ </s" + "[INST] "
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 1, "assistant", hard), (2, None, None, None), (None, 3, "tool", "x"), (3, 0, "assistant", ""), (4, 0, hard, "odd role")]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "conv_id long, turn long, role string, text string, segment string, loss boolean")
    got = chat.digests(chat.format_chats(df)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute.chats(rows)
    assert {r.conv_id: r.valid for r in got} == {1: False, 2: False, None: False, 3: False, 4: False}
    assert chat.format_chats(df.limit(0)).count() == 0
    assert all(chat.INSTRUCT.show(chat.INSTRUCT.hide(x)) == x for x in (hard, "", "\\", "\\\\1;"))
    texts_ = [s.text for s in chat.format_chats(df).collect() if s.kind == "text"]
    assert not any(m in x for x in texts_ for m in chat.INSTRUCT.controls)


# --- op5 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op5_sharding", "sharding_fine"])
@pytest.mark.parametrize("sf", [SMALL, MIDDLE])
def test_sharding_is_its_sql(spark, sf, name):
    con = duckdb.connect()
    views(con, sf)
    got = run(spark, name, sf)
    assert not same(got, con.sql(queries.SQL[name]).df())
    if name == "sharding_fine" and sf == MIDDLE:
        assert got.shard.nunique() > 16 and got.depth.nunique() > 1


def test_sharding_splits_only_what_is_too_large(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = sharding.assign(docs, limit=60_000, step=2).toPandas()
    assert len(got) == docs.count()
    held = got.groupby("shard").n_bytes.agg(["sum", "count"])
    assert ((held["sum"] <= 60_000) | (held["count"] == 1)).all()
    bits = got.drop_duplicates("shard").shard.tolist()
    for s in (s for s in bits if s):  # a leaf's parent held too much
        assert got[got.shard.str.startswith(s[:-1])].n_bytes.sum() > 60_000


def test_sharding_edges(spark):
    got = sharding.assign(edges.docs(spark), limit=400, step=8).toPandas()
    assert Counter(got.n_bytes) == Counter(len((t or "").encode()) for _, t in pairs())
    held = got.groupby("shard").n_bytes.agg(["sum", "count"])
    assert ((held["sum"] <= 400) | (held["count"] == 1)).all()
    many = spark.range(50).select(F.lit(7).cast("long").alias("doc_id"), F.lit("y" * 90).alias("text"))
    got = sharding.assign(many, limit=400, step=20, salt=4).toPandas()
    assert len(got) == 50 and got.groupby("shard").n_bytes.sum().max() <= 400
    assert (got.groupby("shard").n_bytes.transform("sum") == got.shard_bytes).all()
    assert sharding.assign(edges.docs(spark, [])).count() == 0


# --- op6 ---------------------------------------------------------------------------------------------------------------


def test_quality_rules_measures(spark):
    got = run(spark, "op6_quality_rules", MIDDLE).set_index("doc_id")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for d, t in texts(MIDDLE).set_index("doc_id").text.items():
        m = brute.measures(t)
        assert tuple(got.loc[d, columns]) == m, d
        assert got.loc[d, "base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0])
    assert not (got.kept & got.base_failed).any()


def test_quality_rules_verdicts_are_those_of_exact_quartiles(spark):
    """Verdicts of sketches differ from those of sorted values only for documents at a fence, within the sketch's error."""
    t = texts(MIDDLE)
    want = brute.quality_kept([tuple(r) for r in t[["doc_id", "text", "lang", "source"]].itertuples(index=False)])
    got = run(spark, "op6_quality_rules", MIDDLE).set_index("doc_id").kept
    assert len(got) == len(want) and 0 < sum(not k for k, _ in want.values()) < len(want) / 2
    assert not [d for d, (k, near) in want.items() if k != got[d] and not near]
    assert sum(k != got[d] for d, (k, _) in want.items()) <= len(want) / 200


def test_quality_rules_fences_follow_their_cells(spark):
    """No fence is fixed: cells of the driver's table have fences of their own, and a shifted source shifts its own most."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang", "source", quality_rules.measures("text").alias("measures"))
    fences = lambda df: {(r.f_lang, r.f_source): (r.high, r.low) for r in quality_rules.fit(df, quality_rules.default_fences()).collect()}
    before = fences(docs)
    for name in quality_rules.default_fences():
        assert len({round(high[name], 9) for high, _ in before.values()}) > len(before) / 2  # cells of equal size may have quartiles in the same bins
    m = F.col("measures")
    shifted = F.when((F.col("lang") == "en") & (F.col("source") == "src3"), m.withField("word_chars", 2 * m["word_chars"])).otherwise(m)
    after = fences(docs.withColumn("measures", shifted))
    key = ("en", "src3")
    own = after[key][0]["word_length"] / before[key][0]["word_length"]
    assert own > 1.1 and all(after[k][0]["word_length"] / before[k][0]["word_length"] < own for k in before if k != key)


def test_quality_rules_edges(spark):
    got = quality_rules.apply_rules(edges.docs(spark)).select("text", "measures.*", "kept").collect()
    assert len(got) == len(edges.ROWS)
    assert all(tuple(r)[1:6] == brute.measures(r.text) for r in got)
    assert not any(r.kept for r in got if r.n_words < 50)
    assert quality_rules.apply_rules(edges.docs(spark, [])).count() == 0


def test_quality_rules_cells_decide(spark):
    """One text, in two sources whose texts differ: kept where such texts are usual, and not elsewhere."""
    body = lambda k, extra: " ".join([f"w{k:03}x{i:02}"[: 5 + (k + i) % 3] + str(i) for i in range(100)] + extra)
    signs = [(k, body(k, ["#"] * (4 + k % 8)), "en", "signs") for k in range(300)]
    plain = [(k + 300, body(k, []), "en", "plain") for k in range(300)]
    long = [(k + 600, " ".join(f"{'z' * (7 + (k + i) % 6)}{i:02}" for i in range(100)), "en", "long") for k in range(300)]
    probes = [(9000, body(7, ["#"] * 9), "en"), (9001, " ".join(f"{'y' * 8}{i:02}" for i in range(100)), "en")]
    rows = signs + plain + long + [(*p, s) for p in probes for s in ("signs", "plain", "long")]
    kept = {(r.doc_id, r.source): r.kept for r in quality_rules.apply_rules(edges.docs(spark, rows, clashes=False)).collect()}
    assert (kept[9000, "signs"], kept[9000, "plain"]) == (True, False)
    assert (kept[9001, "long"], kept[9001, "plain"]) == (True, False)
    assert all(v for (d, _), v in kept.items() if d < 9000)


def test_quality_rules_keep_labelled_clean_rows(spark):
    got = run(spark, "op6_quality_rules", LARGE).merge(pd.read_parquet(f"{LARGE}/labels.parquet"), on="doc_id")
    past = got[~got.base_failed]
    assert past[(past.quality == 1) & (past.toxic == 0)].kept.mean() > 0.998
    assert not past[past.quality == 0].kept.any()


# --- op7 ---------------------------------------------------------------------------------------------------------------


def test_simhash_is_brute_force(spark):
    t = texts(MIDDLE)
    got = run(spark, "op7_simhash", MIDDLE)
    assert Counter(got.itertuples(index=False, name=None)) == Counter(brute.simhash_components(list(zip(t.doc_id, t.text, strict=True))))


def test_simhash_edges(spark):
    got = simhash.groups(edges.docs(spark)).select("doc_id", simhash.hex_of(F.col("fp")), "component_id")
    assert rows_of(got, "*") == Counter(brute.simhash_components(pairs()))
    kept = simhash.representatives(edges.docs(spark)).select("doc_id").collect()
    want = {(c, root) for _, _, c, root in brute.simhash_components(pairs(), roots=True)}
    assert Counter(r[0] for r in kept) == Counter(c for c, _ in want)
    assert simhash.groups(edges.docs(spark, [])).count() == 0


def test_simhash_full_postings_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 12, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(25):
            fps.add(int(b) ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, 6)), replace=False)))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")

    def parts(links) -> set:
        root = {f: f for f in fps}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {(f, find(f)) for f in fps}

    want = parts((a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3)
    for most in (2048, 2):
        assert parts(tuple(r) for r in simhash.links(df, most=most).collect()) == want


# --- op8 ---------------------------------------------------------------------------------------------------------------


def library() -> tiktoken.Encoding:
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens_of(enc, text: str | None) -> tuple[int, str, str]:
    ids = enc.encode_ordinary(text or "")
    return len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha((text or "").encode())


def test_bpe_is_the_librarys(spark):
    enc = library()
    got = run(spark, "op8_bpe", MIDDLE).set_index("doc_id")
    for d, t in texts(MIDDLE).set_index("doc_id").text.items():
        assert tuple(got.loc[d, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == tokens_of(enc, t), d


def test_bpe_edges(spark):
    enc = library()
    got = bpe.tokenize(edges.docs(spark), public_tokenizers.path(bpe.VOCABULARY))
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == Counter((d, *tokens_of(enc, t)) for d, t in pairs())
    assert bpe.tokenize(edges.docs(spark, []), public_tokenizers.path(bpe.VOCABULARY)).count() == 0
    own = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY))
    for text in ("ab" * 700, "<|endoftext|>", "\x00\x7f", "ŋ" * 300, "a" * 257, " " * 600 + "x"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == enc.encode_ordinary(text)


# --- op9 ---------------------------------------------------------------------------------------------------------------


def test_substrings_are_brute_force(spark):
    t = texts(MIDDLE)
    got = run(spark, "op9_substring_dedup", MIDDLE)
    want = Counter((d, n, r, brute.sha(k.encode())) for d, n, r, k in brute.substring_kept(list(zip(t.doc_id, t.text, strict=True))))
    assert Counter(got.itertuples(index=False, name=None)) == want and got.n_removed.sum() > 0


def test_substrings_edges(spark, monkeypatch):
    for size in (substrings.UNIT_WORDS, 50):  # with 50, each text is a unit of its own, and words are forgotten in between
        monkeypatch.setattr(substrings, "UNIT_WORDS", size)
        got = substrings.remove_repeats(edges.docs(spark))
        assert rows_of(got, "doc_id", "dedup.n_words", "dedup.n_removed", "dedup.kept") == Counter(brute.substring_kept(pairs()))
    assert substrings.remove_repeats(edges.docs(spark, [])).count() == 0


def test_substrings_units_and_buckets(monkeypatch):
    """Many units, and more buckets than entries: the same windows as by comparing all, in one process."""
    rng = np.random.default_rng(2)
    passages = [[f"p{k}w{i}" for i in range(rng.integers(20, 70))] for k in range(12)]
    texts_ = [[w for k in rng.integers(0, 12, 3) for w in [*passages[k], *[f"d{d}x{i}" for i in range(rng.integers(0, 30))]]] for d in range(60)]
    window, block = 20, 10
    for buckets in (1, 7, 5000):
        words = substrings.WordHashes()

        def settle(make, step, hits=None):
            found, by_bucket, rids = {}, {}, {}
            for at in range(0, 60, 9):
                unit = substrings.Unit()
                for d in range(at, min(60, at + 9)):
                    unit.add(d.to_bytes(16, "big"), d, words.of([w.encode() for w in texts_[d]]), None if hits is None else np.array(sorted(hits.get(d, [])), np.int64))
                for b, number, kind, data in make(unit):
                    if kind == substrings.DIRECTORY:
                        rids[number] = [int.from_bytes(data[k : k + 16], "big") for k in range(0, len(data), 16)]
                    elif kind == substrings.RESULT:
                        found.setdefault(number, []).append(data)
                    else:
                        by_bucket.setdefault(b, []).append((number, data))
            for entries in by_bucket.values():
                for number, data in step(entries):
                    found.setdefault(number, []).append(data)
            out: dict[int, set[int]] = {}
            for number, rows in found.items():
                for data in rows:
                    d, s = substrings.parted(data, 2)
                    for doc, start in zip(substrings.unpack(d, True), substrings.unpack(s, False), strict=True):
                        out.setdefault(rids[number][doc], set()).add(int(start))
            return out

        hits = settle(lambda u: substrings.anchors(u, buckets, block), substrings.met)
        starts = settle(lambda u: substrings.windows(u, buckets, window, block), substrings.repeated, hits)
        got = {d: [x for a, b in substrings.spans_of(np.array(sorted(starts.get(d, [])), "<u4").tobytes(), window) for x in range(a, b)] for d in range(60)}
        want = brute.substring_kept([(d, " ".join(t)) for d, t in enumerate(texts_)])
        assert [len(got[d]) for d in range(60)] == [removed for _, _, removed, _ in want]
        assert [" ".join(w for k, w in enumerate(texts_[d]) if k not in set(got[d])) for d in range(60)] == [k for *_, k in want]


def test_substrings_spans_and_texts():
    raw = b"  one two\nthree  four\n\nfive six "
    assert substrings.spans_of(np.array([0, 1, 5, 9], "<u4").tobytes(), 3) == [(0, 4), (5, 8), (9, 12)]
    assert substrings.kept_text(raw, [(1, 3)]) == b"  one four\n\nfive six "
    assert substrings.kept_text(raw, [(0, 1), (4, 6)]) == b"  two\nthree  four\n\n"
    assert substrings.kept_text(raw, []) == raw and substrings.kept_words(raw.split(), [(0, 6)]) == b""


# --- op10 --------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    """At sf0.1: smaller tables hold too few toxic rows to learn other languages' words from (45 at sf0.01)."""
    got = run(spark, "op10_toxicity", LARGE).merge(pd.read_parquet(f"{LARGE}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95
    assert (held[held.toxic == 1].predicted == 1).mean() >= 0.85


def test_toxicity_grammar_reads_clauses():
    weigh = lambda t: toxicity.Reader({}).weigh(t)[0]
    assert weigh("you are an idiot") > weigh("an idiot") > weigh("he said that was no idiot") > 0
    assert weigh("not an idiot") < weigh("an idiot")
    assert weigh("they will kill you") > weigh("they will call you") == 0
    assert weigh("nice. idiot. fine") == weigh("idiot")
    assert weigh("kill the process") == 0


def test_toxicity_grammar_reads_targets_that_follow():
    weigh = lambda t: toxicity.Reader({}).weigh(t)[0]
    assert weigh("I will kill you") == weigh("you I will kill") > 0
    assert weigh("gonna stab him") > 0 and weigh("murder them all") > 0
    assert 0 < weigh("I will not kill you") < weigh("I will kill you")
    assert weigh("I will not kill any one single person of you") == weigh("I will not kill you")  # the negation is the verb's
    assert 0 < weigh("John said I will kill you") < weigh("I will kill you")
    assert weigh("kill the process. you can wait") == 0
    assert weigh("idiot, all of you") == weigh("you idiot") > weigh("idiot, all of it")
    assert weigh("not an idiot, all of you") < weigh("idiot, all of you")
    assert weigh("idiot, you and you") == weigh("idiot, you")


def test_toxicity_grammar_reads_both_sides():
    weigh = lambda t: toxicity.Reader({}).weigh(t)[0]
    assert weigh("I will kill you") > 0 and weigh("go kill yourself") > 0 and weigh("kill you all") > 0
    assert weigh("they stab at the answer") == weigh("she will strangle the debate") == 0
    assert weigh("idiot you are") == weigh("you idiot") > weigh("an idiot")
    assert 0 < weigh("an idiot, it said") < weigh("an idiot") and weigh("the paper said: an idiot") < weigh("an idiot")


NAMES = [f"{a}{b}" for a in ("ban", "cor", "del", "fim", "gor", "hul", "jav", "kes", "lom", "mip") for b in ("a", "e", "i", "o", "u", "an", "en", "in", "on", "un")]


def clauses(rng, words: list[str]) -> str:
    """A clause of `words` between others that mean nothing."""
    some = lambda n: " ".join(rng.choice(NAMES, n))
    return f"{some(9)}. {some(2)} {' '.join(words)} {some(2)}. {some(9)}."


def told(rng, n: int) -> tuple[list[str], list[int]]:
    """Texts with words that no list has: an insult is toxic, unless negated or reported; a threat is, with its target alone."""
    texts_, y = [], []
    for k in range(n):
        more = list(rng.choice(NAMES, 4))
        words, label = [
            (["zorp"], 1),
            (["zorp", *more], 1),
            (["nixa", rng.choice(["zorp", "idiot", "idiot"])], 0),
            ([rng.choice(["zorp", "idiot", "idiot"]), *more, "quoth"], 0),
            (["idiot", *more], 1),
            (["mangle", "you"], 1),
            (["mangle", "thee"], 1),
            (["mangle", *more], 0),
            (more, 0),
            (["you", *more], 0),
            (["thee", *more], 0),
        ][k % 11]
        texts_.append(clauses(rng, words))
        y.append(label)
    return texts_, y


def test_toxicity_learns_all_symbols_and_clauses_beat_words():
    """With the same lexicon, the plain sum of its words and a curve of its own, held-out rows get worse."""
    rng = np.random.default_rng(11)
    x, y = told(rng, 1600)
    model = toxicity.fit(x, y)
    assert "zorp" in model.lexicon and not {"mangle", "nixa", "quoth", "thee"} & set(model.lexicon)
    assert {k: model.context.get(k) for k in ("mangle", "thee", "nixa", "quoth")} == {"mangle": toxicity.THREAT, "thee": toxicity.TARGET, "nixa": toxicity.NEGATION, "quoth": toxicity.REPORT}
    assert set(model.context) == {"mangle", "thee", "nixa", "quoth"}
    reader = toxicity.Reader(model.lexicon, model.context)

    def plain(text: str) -> tuple[float, int]:
        found = [reader.symbol(w) for w in text.split()]
        return sum(s for k, s in found if k in (toxicity.INSULT, toxicity.THREAT)), len(found)

    curve = toxicity.fit_curve([plain(t)[0] for t in x], [plain(t)[1] for t in x], y)
    words = toxicity.Grammar(model.lexicon, model.context, curve)
    held, want = told(rng, 800)
    by_clause = [model.score(w, n) >= 0.5 for w, _, n in map(reader.weigh, held)]
    by_word = [words.score(*plain(t)) >= 0.5 for t in held]
    right = lambda got: np.mean([g == bool(w) for g, w in zip(got, want, strict=True)])
    assert right(by_clause) > 0.97 and right(by_clause) > right(by_word) + 0.1


def test_toxicity_edges(spark):
    got = toxicity.score_toxicity(edges.docs(spark), toxicity.fit([], [])).select("text", "toxicity.*").collect()
    assert len(got) == len(edges.ROWS) and all(0 <= r.score < 0.5 and r.clauses == 0 for r in got)
    assert toxicity.score_toxicity(edges.docs(spark, []), toxicity.fit([], [])).count() == 0
