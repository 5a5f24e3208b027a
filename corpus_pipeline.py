"""From raw documents to token ids: quality rules, near-duplicates, repeated passages, mixing, tokens.

Every stage takes all that the one before kept, and all but the last return the columns of documents. Nulls: a null text has
no words, and the quality rules reject it; a null id, language or source is a value like others. Empty and very long texts
are read whole. Rows of equal id and text are one document from the second stage on; of equal texts with other ids the
smallest id stays. Empty tables pass through as empty. Extra columns ride along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm.bpe import VOCABULARY, tokenize
from cataloom.llm.common import cut, packed, read, release, unpacked
from cataloom.llm.mixing import mix
from cataloom.llm.quality_rules import apply_rules
from cataloom.llm.simhash import representatives
from cataloom.llm.substrings import remove_repeats


#: What the operators read.
READ = ("doc_id", "text", "lang", "source")


def through(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an operator keeps of `docs`, in their own columns."""
    return operator(packed(docs, READ)).select(*unpacked(docs.columns, READ))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fences of their language and source keep."""
    return through(docs, lambda rows: apply_rules(rows).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return through(docs, representatives)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start earlier in the corpus; the rest of a text, with its lines, stays as it is."""
    cut_out = F.when(F.col("dedup.n_removed") > 0, F.col("dedup.kept")).otherwise(F.col("text"))
    out = through(docs, lambda rows: remove_repeats(rows, keep="text").withColumn("text", cut_out))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their rates, which are at most 1: after de-duplication nothing is repeated, and clean tokens all stay."""
    labels = read(spark, sf_dir, "labels")
    return through(docs, lambda rows: mix(rows, labels, anchor="clean", most=1.0).where("copies > 0"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenize(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("target_mix", target_mix),
    ("tokens", tokens),
]

#: SQL has no SimHash of XXH64, no trained classifier and no byte-pair merges; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
            release(before)  # nothing but this stage has read it
    return docs
