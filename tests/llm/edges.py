"""Hard rows: nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cataloom.llm.common import quoted

LONG = " ".join(f"w{k % 977}x{k % 1009}" for k in range(40_000))
SHARED = " ".join(f"shared{k}" for k in range(55))
ROWS = [
    (1, "", "en", "s1"),
    (2, None, "en", "s1"),
    (None, "a text whose id is null", "en", "s1"),
    (None, "a text whose id is null", "en", "s1"),
    (None, None, None, None),
    (3, LONG, "en", "s2"),
    (4, LONG, None, "s2"),
    (5, f"first {SHARED} one", "en", None),
    (6, f"second {SHARED} two", "de", "s1"),
    (6, f"second {SHARED} two", "de", "s1"),
    (6, "another text with an id that is there already", "de", "s1"),
    (7, " \t\n\x0b\x0c\r ", "en", "s1"),
    (8, "Grüße 你好 😀 naïve space", "de", "s1"),
    (9, "same same same same same same same", "en", "s1"),
    (10, "z" * 5000, "en", "s1"),
    (11, "line one\nline one\nline two\n\nline one", "en", "s1"),
    (12, "grüße 你好 😀 naïve space", "de", "s1"),
    (13, f"{SHARED} {SHARED}", "en", "s1"),
]
#: Names that operators use for columns of their own.
CLASHES = ("shard", "kept", "measures", "scored", "rate", "copies", "dedup", "toxicity", "fp", "rid", "_rid", "_places", "bits", "high", "f_lang", "f_part", "a.b", "back`tick")


def docs(spark: SparkSession, rows=ROWS, clashes: bool = True) -> DataFrame:
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {quoted(c)} string" for c in CLASHES if clashes)
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(CLASHES) * clashes) for r in rows], schema)


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 1, 0), (6, 0, 0), (None, 1, 1), (8, None, None), (9, 0, 1)], "doc_id long, quality int, toxic int")
