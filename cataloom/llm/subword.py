"""Supervised subword embeddings: learned vectors of hashed words and character n-grams, averaged over a document, softmax.

Trained by stochastic gradient descent in numpy on a bounded sample of labelled rows (see samples.py; at most 4,000 texts
by default). Scoring runs in the workers over whole texts: since the output is linear in the averaged vectors, a word's
part of the logits is one small vector, remembered for up to `REMEMBERED` words. Words that are new in a batch are hashed
together: their code points are one array, and an n-gram's hash is a sum over shifted views of it.

A word equal to the one before also counts as the feature REPEAT. Texts without a word get the bias alone; null is empty.
Equal texts get equal scores, so repeated rows do, and ties stay ties. Empty tables give empty results. Extra columns stay,
`scored` is replaced. A null id can't be drawn for training; the query counts it as held out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import as_bytes, bound_batches, crc32_of_id, give_back, read
from .samples import labelled_sample

BUCKETS = 1 << 17
DIM = 12
#: Lengths of character n-grams.
GRAMS = (3,)
REMEMBERED = 250_000
REPEAT = 0
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_SPREAD, _SHIFT = np.uint64(0xFF51AFD7ED558CCD), np.uint64(32)


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    """1 to BUCKETS - 1."""
    x = hashes * _SPREAD
    x = (x ^ (x >> _SHIFT)) * _SPREAD
    return (1 + (x >> _SHIFT) % np.uint64(BUCKETS - 1)).astype(np.int64)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word numbers) of words and of their character n-grams, with marks at both ends of a word."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    marked = (b"<" + b">\n<".join(words) + b">").decode("utf-8", "replace")  # no word has a newline
    code = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = code == 10
    word = np.cumsum(ends) - ends
    first = np.concatenate(([0], np.flatnonzero(ends) + 1))
    place = np.arange(len(code)) - first[word]
    powers = np.cumprod(np.full(int(place.max()) + 1, _ODD[0], np.uint64))
    whole = np.add.reduceat(np.where(ends, np.uint64(0), code * powers[place]), first)
    found, of = [buckets_of(whole)], [np.arange(len(words))]
    for n in GRAMS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        inside = (word[:m] == word[n - 1 :]) & ~ends[n - 1 :]
        hashes = np.full(m, n, np.uint64)
        for k in range(n):
            hashes = hashes * np.uint64(31) + code[k : k + m] * np.uint64(_ODD[k])
        found.append(buckets_of(hashes[inside]))
        of.append(word[:m][inside])
    return np.concatenate(found), np.concatenate(of)


def counted(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text. Every distinct word is hashed once."""
    places = _Places()
    rows = [np.fromiter(map(places.__getitem__, words := raw.split()), np.int64, len(words)) for raw in texts]
    flat, of = features(places.new)
    order = np.argsort(of, kind="stable")
    flat, sizes = flat[order], np.bincount(of, minlength=len(places))
    start = np.cumsum(sizes) - sizes
    out = []
    for row in rows:
        some, times = np.unique(row, return_counts=True)
        n = sizes[some]
        at = np.repeat(start[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        every = np.concatenate(([REPEAT], flat[at]))
        idx, back = np.unique(every, return_inverse=True)
        count = np.bincount(back, np.concatenate(([np.count_nonzero(row[1:] == row[:-1])], np.repeat(times, n))))
        out.append((idx[count > 0].astype(np.int32), count[count > 0]))
    return out


@dataclass
class Model:
    """parts: each bucket's part of the logits (BUCKETS x classes); bias: of each class."""

    parts: np.ndarray
    bias: np.ndarray


def train(texts: list[str], y: list[int], classes: int, epochs: int = 5, steps: int = 700, batch: int = 32, rate: float = 0.6, seed: int = 7) -> Model:
    """Vectors and output weights by SGD with per-weight step sizes (Adagrad). No rows: even odds for every text."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = rng.normal(0, 0.3, (DIM, classes)), np.zeros(classes)
    if not texts:
        return Model(np.zeros((BUCKETS, classes), np.float32), bias)
    rows = counted([t.encode() for t in texts])
    target = np.asarray(y)
    bias = np.log(np.bincount(target, minlength=classes) + 1.0)
    bias -= bias.mean()
    epochs = max(epochs, -(-steps * batch // len(rows)))  # small samples are gone through more often
    seen_v, seen_w, seen_b = np.full(BUCKETS, 1e-6), np.full(weights.shape, 1e-2), np.full(classes, 1e-2)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            idx = np.concatenate([rows[i][0] for i in some])
            part = np.concatenate([rows[i][1] / max(1, rows[i][1].sum()) for i in some])
            doc = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            own = vectors[idx]
            mean = np.stack([np.bincount(doc, own[:, d] * part, len(some)) for d in range(DIM)], axis=1)
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), target[some]] -= 1
            back, g_w, g_b = p @ weights.T, mean.T @ p / len(some), p.mean(axis=0)
            new, place = np.unique(idx, return_inverse=True)
            g = np.stack([np.bincount(place, back[doc, d] * part, len(new)) for d in range(DIM)], axis=1)
            seen_v[new] += (g * g).mean(axis=1)
            vectors[new] -= (step * 0.1 * g / np.sqrt(seen_v[new])[:, None]).astype(np.float32)
            seen_w += g_w * g_w
            seen_b += g_b * g_b
            weights -= step * g_w / np.sqrt(seen_w)
            bias -= 0.1 * step * g_b / np.sqrt(seen_b)
    return Model((vectors @ weights).astype(np.float32), bias)


class _Places(dict):
    """Word -> row of the scorer's table; words not met before get the next rows and wait in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Scorer:
    """Class probabilities of texts, with words remembered; `extra` gives a number for each word, to be summed beside."""

    def __init__(self, model: Model, extra: Callable[[bytes], float] | None = None):
        self.model, self.classes, self.extra = model, model.parts.shape[1], extra
        self._forget()

    def _forget(self) -> None:
        self.at, self.table = _Places(), np.zeros((1024, self.classes + 2))

    def _learn(self) -> None:
        new, n = self.at.new, len(self.at)
        while n > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        flat, of = features(new)
        rows = self.table[n - len(new) : n]
        for c in range(self.classes):
            rows[:, c] = np.bincount(of, self.model.parts[flat, c], len(new))
        rows[:, -2] = np.bincount(of, minlength=len(new))
        if self.extra:
            rows[:, -1] = np.fromiter(map(self.extra, new), np.float64, len(new))
        self.at.new = []

    def score(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities, words, sum of extras) of each text; equal texts get equal values."""
        if len(self.at) > REMEMBERED:
            self._forget()
        found = [np.fromiter(map(self.at.__getitem__, words := raw.split()), np.int64, len(words)) for raw in raws]
        if self.at.new:
            self._learn()
        repeat = np.append(self.model.parts[REPEAT].astype(np.float64), [1.0, 0.0])
        sums = np.stack([self.table[rows].sum(axis=0) + repeat * np.count_nonzero(rows[1:] == rows[:-1]) for rows in found] or [np.zeros(self.classes + 2)])[: len(raws)]
        logits = self.model.bias + sums[:, :-2] / np.maximum(1.0, sums[:, -2:-1])
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return np.round(p / p.sum(axis=1, keepdims=True), 6), np.fromiter(map(len, found), np.int64, len(found)), sums[:, -1]


SCORED = StructType([StructField("p", ArrayType(DoubleType())), StructField("n_words", LongType())])


def scorer_udf(model: Model, spark: SparkSession):
    """text -> struct(p, n_words). The model has a fixed size (BUCKETS x classes, 4 bytes each), whatever the data's."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf(SCORED)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        scorer = Scorer(held.value)
        for text in batches:
            p, n, _ = scorer.score(as_bytes(text))
            ends = pa.array(np.arange(0, p.size + 1, scorer.classes, dtype=np.int32))
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(p.ravel())), pa.array(n)], fields=[pa.field("p", pa.list_(pa.float64())), pa.field("n_words", pa.int64())])

    return scored


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with scored: a struct of p (a probability for each class, rounded to 6 places) and n_words."""
    bound_batches(docs.sparkSession)
    return docs.drop("scored").withColumn("scored", scorer_udf(model, docs.sparkSession)("text"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.pmod(crc32_of_id(), F.lit(4)) == 2, F.lit(True))
    texts, y = labelled_sample(docs, read(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("quality").alias("y")))
    p = F.col("scored.p")[1]
    return score_documents(docs, train(texts, y, 2)).select("doc_id", held.alias("held_out"), p.alias("score"), F.when(p >= 0.7, 1).otherwise(0).alias("predicted"))
