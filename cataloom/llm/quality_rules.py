"""Quality rules with thresholds that follow the data.

Counts of each text come from one pass. A mergeable quantile sketch for each measure, language and source then replaces
fixed cutoffs: values fall into logarithmic bins of a fixed relative error (as DDSketch does), so that a sketch is a small
set of (bin, count) rows, partial sketches of tasks merge by adding counts, and the result doesn't depend on the order.
A hot source sends one row for each bin and task. Texts that fail the base rules are out already and don't count.

Fences have no fixed cutoff, floor or ceiling. With a and b the quartiles of a measure in a cell, the upper fence is
`b * (b / a) ** reach`, the lower one `a / (b / a) ** reach`: in the sketch's own logarithms, quartiles and a multiple of
their distance, which counts as at least `least` (a ratio), for cells whose texts are all alike. Rates count one find more
than a text has: a text of n words without any says only that the rate is under about 1 / n, so that quartiles of rates are
never 0, and a short text isn't out for one find.

A cell of few rows says little. Its quartiles are weighed with those of its language, these with those of all rows, in
logarithms and by rows: a cell of n rows has n / (n + prior) of the say. There is no size at which the rule changes.

Nulls: a null text has no words; null lang or source are cells of their own. Texts without words get zero measures. Rows
that are repeated count each time and get the same verdict; rows of one value tie within a fence, which they may equal.
Empty tables give empty results. Extra columns stay, whatever their names; columns named `measures` or `kept` are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bound_batches, cut, give_back, quoted, read

MEASURES = pa.struct([(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
MEASURES_TYPE = StructType([StructField(x.name, LongType()) for x in MEASURES])
SYMBOLS = b"#*$%&|<>"
_NOT_WORD = b" \t\n\x0b\x0c\r"
#: Continuation bytes of UTF-8 are no code points of their own.
_CONTINUED = bytes(range(0x80, 0xC0))


def measure(raw: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text's UTF-8."""
    words = raw.split()
    n = len(words)
    chars = len(raw.translate(None, _NOT_WORD + _CONTINUED))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        found = Counter(windows)
        if len(found) < len(windows):
            twice = np.fromiter(map(found.__getitem__, windows), np.int64, len(windows)) > 1
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


@F.arrow_udf(MEASURES_TYPE)
def measures(text: pa.Array) -> pa.Array:
    give_back()
    rows = [measure(x or b"") for x in text.cast(pa.binary()).to_pylist()]
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(MEASURES))


@dataclass(frozen=True)
class Fence:
    """A measure's limits, by the sketch of its cell."""

    value: Column
    #: Distance of a fence from its quartile, in distances of the quartiles.
    reach: float
    #: The least ratio of the quartiles that counts.
    least: float
    lower: bool = False


def _rate(part: str) -> Column:
    return (F.col(f"measures.{part}") + 1) / (F.col("measures.n_words") + 1)


def default_fences() -> dict[str, Fence]:
    words, chars = F.col("measures.n_words"), F.col("measures.word_chars")
    return {
        "symbols": Fence(_rate("n_symbols"), 1.5, 3.0),
        "dup_lines": Fence(_rate("n_dup_lines"), 1.5, 3.0),
        "repeats": Fence(_rate("n_repeat_words"), 2.0, 6.0),
        "word_length": Fence(chars / F.greatest(words, F.lit(1)), 4.0, 1.035, lower=True),
    }


#: Bins are powers of GAMMA: values in one differ by at most 2 %.
GAMMA = 1.02
LEAST = 1e-4


def bin_of(value: Column) -> Column:
    return F.when(value <= LEAST, F.lit(0)).otherwise(F.ceil(F.log(value / LEAST) / F.log(F.lit(GAMMA))).cast("int"))


def value_of(b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.lit(LEAST) * F.pow(F.lit(GAMMA), b))


def sketch(rows: DataFrame, fences: dict[str, Fence]) -> DataFrame:
    """(lang, source, measure, bin, n): sketches that merge by adding n."""
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), bin_of(f.value).alias("bin")) for k, f in fences.items()])
    return rows.select("lang", "source", F.inline(pairs)).groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def _by_measure(fences: dict[str, Fence], of) -> Column:
    """A value of each measure's fence, for rows with `measure`."""
    return F.create_map(*[F.lit(y) for k, f in fences.items() for y in (k, of(f))])[F.col("measure")]


def quartiles(merged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, rows, a, b): quartiles of sketches merged by keys; the bins of one measure are few, so windows over them are small."""
    by = merged.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*keys, "measure")
    run = by.withColumn("upto", F.sum("n").over(part.orderBy("bin"))).withColumn("rows", F.sum("n").over(part))
    at = lambda q: value_of(F.min(F.when(F.col("upto") >= F.col("rows") * q, F.col("bin"))))
    return run.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), at(0.25).alias("a"), at(0.75).alias("b"))


def fit(rows: DataFrame, fences: dict[str, Fence], prior: float = 25.0) -> DataFrame:
    """(f_lang, f_source, high, low): maps from measure to fence. `rows` has lang, source and measures."""
    cells = cut(sketch(rows.where(~base_failed()), fences), "quality-sketch")
    own = quartiles(cells, ["lang", "source"])
    lang = quartiles(cells, ["lang"]).select(F.col("lang").alias("l"), F.col("measure").alias("lm"), F.col("rows").alias("l_rows"), F.col("a").alias("la"), F.col("b").alias("lb"))
    every = quartiles(cells, []).select(F.col("measure").alias("em"), F.col("a").alias("ea"), F.col("b").alias("eb"))
    x = own.join(lang, own["lang"].eqNullSafe(lang["l"]) & (own["measure"] == lang["lm"])).join(F.broadcast(every), F.col("measure") == F.col("em"))  # `every` has one row for each measure

    def weighed(q: str) -> Column:
        say = lambda n: F.col(n) / (F.col(n) + F.lit(prior))
        log = lambda c: F.log(F.greatest(F.col(c), F.lit(LEAST)))
        whole = say("l_rows") * log(f"l{q}") + (1 - say("l_rows")) * log(f"e{q}")
        return F.exp(say("rows") * log(q) + (1 - say("rows")) * whole)

    x = x.select("lang", "source", "measure", weighed("a").alias("a"), weighed("b").alias("b"))
    by = lambda of: F.create_map(*[F.lit(y) for k, f in fences.items() for y in (k, of(f))])[F.col("measure")]
    beyond = F.pow(F.greatest(F.col("b") / F.col("a"), by(lambda f: f.least)), by(lambda f: f.reach))
    high, low = F.col("b") * beyond, F.when(by(lambda f: f.lower), F.col("a") / beyond)
    entries = lambda c, name: F.map_from_entries(F.collect_list(F.struct("measure", c.alias("at")))).alias(name)  # noqa: E731 - of a handful of measures
    return x.groupBy(F.col("lang").alias("f_lang"), F.col("source").alias("f_source")).agg(entries(high, "high"), entries(low, "low"))


def base_failed() -> Column:
    n = F.col("measures.n_words")
    return (n < 50) | (100 * F.col("measures.n_repeat_words") > 50 * n)


#: Most cells whose fences are broadcast (under 300 bytes each); of more, a cell's rows are dealt over SALT parts.
BROADCAST_CELLS = 100_000
SALT = 32


def judge(rows: DataFrame, thresholds: DataFrame, fences: dict[str, Fence]) -> DataFrame:
    """`rows` and kept: whether the base rules and all fences of the row's language and source hold. Thresholds are counted: no hot cell meets in one task."""
    thresholds = cut(thresholds, "quality-fences")
    same = rows["lang"].eqNullSafe(thresholds["f_lang"]) & rows["source"].eqNullSafe(thresholds["f_source"])
    if thresholds.count() <= BROADCAST_CELLS:
        x = rows.join(F.broadcast(thresholds), same, "left")
    else:
        part = F.pmod(F.xxhash64("measures", "doc_id"), F.lit(SALT))
        dealt = thresholds.withColumn("f_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        x = rows.join(dealt, same & (part == dealt["f_part"]), "left")
    fine = ~base_failed()
    for k, f in fences.items():
        fine &= F.coalesce(f.value <= thresholds["high"][k], F.lit(True)) & F.coalesce(f.value >= thresholds["low"][k], F.lit(True))
    return x.select(*[rows[quoted(c)] for c in rows.columns if c != "kept"], fine.alias("kept"))


def apply_rules(docs: DataFrame, fences: dict[str, Fence] | None = None, prior: float = 25.0) -> DataFrame:
    """`docs` with measures (a struct) and kept.

    Texts are measured once: they and their measures are one table in the shared folder, read for the sketches without the
    texts, and for the verdicts; no text is shuffled.
    """
    bound_batches(docs.sparkSession)
    fences = fences or default_fences()
    rows = cut(docs.drop("measures", "kept").withColumn("measures", measures("text")), "quality-measured")
    return judge(rows, fit(rows, fences, prior), fences)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures are taken once and stored without the texts: sketches and verdicts need no second pass over those."""
    bound_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", measures("text").alias("measures"))
    rows, fences = cut(docs, "quality-measures"), default_fences()
    done = judge(rows, fit(rows, fences), fences)
    return done.select("doc_id", "measures.*", base_failed().alias("base_failed"), "kept")
