"""The pipeline, each stage beside a plain version over the rows it got."""

from __future__ import annotations

import corpus_pipeline as pipeline
import public_tokenizers

from cataloom.llm import bpe
from cataloom.llm.common import cut
from tests.llm import brute, edges
from tests.llm.test_operators import library, tokens_of

SF = "/root/testdata/sf0.01"


def test_each_stage(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        columns = docs.columns
        docs = cut(stage(spark, docs, SF), f"test-{name}")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        kept[name] = (before, after)
        if name != "tokens":
            assert docs.columns == columns
    before, after = kept["quality_rules"]
    failed = {d for d, t in before.items() if (m := brute.measures(t))[0] < 50 or 2 * m[4] > m[0]}
    assert not failed & set(after) and len(after) > 0.9 * (len(before) - len(failed))
    before, after = kept["near_duplicates"]
    assert set(after) == {c for _, _, c in brute.simhash_components(list(before.items()))}
    before, after = kept["repeated_passages"]
    for d, _, removed, text in brute.substring_kept(list(before.items())):
        assert " ".join(brute.words(after[d].text)) == text and (removed or after[d].text == before[d]) and after[d].n_chars == len(after[d].text)
        assert set(after[d].text.split("\n")) <= set(before[d].split("\n")) or removed
    before, after = kept["target_mix"]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [d for d in before if d in labels and labels[d].quality == 1 and labels[d].toxic == 0]
    assert len([d for d in clean if d in after]) >= 0.95 * len(clean)
    before, after = kept["tokens"]
    enc = library()
    assert all((after[d].n_tokens, after[d].ids_sha256, after[d].decoded_sha256) == tokens_of(enc, t) for d, t in before.items())


def test_stages_take_hard_rows_and_none(spark, tmp_path):
    edges.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (edges.ROWS, []):
        for _, stage in pipeline.STAGES:
            stage(spark, edges.docs(spark, rows), str(tmp_path)).count()
    assert public_tokenizers.path(bpe.VOCABULARY)
