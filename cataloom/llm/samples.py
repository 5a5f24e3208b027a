"""Bounded samples of labelled texts, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Most rows of a sample, and the longest text that may be in it: together the bound of what the driver gets.
ROWS = 4000
TEXT_BYTES = 50_000


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS, text_bytes: int = TEXT_BYTES) -> tuple[list[str], list[int]]:
    """(texts, labels) of at most `rows` documents, chosen by a hash of their ids. `labels` has doc_id and y; null rows don't count.

    Of repeated ids the least text and label stand. Fewer labels of documents that are there than `rows`: all of them. Ids
    meet first, without texts; those of the chosen documents alone follow.
    """
    labels = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").cast(LongType()).alias("y"))
    docs = docs.where((F.octet_length("text") <= text_bytes) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    chosen = labels.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).toArrow()  # at most `rows` rows
    order = sorted(range(got.num_rows), key=got.column("doc_id").to_pylist().__getitem__)
    text, y = got.column("text").to_pylist(), got.column("y").to_pylist()
    return [text[k] for k in order], [y[k] for k in order]
