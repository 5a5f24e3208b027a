"""Mixing to target weights by soft membership.

A classifier fitted on the labelled table gives each document a posterior over domains, so that a document's tokens count
for every domain by their share. The domains are those that labels tell apart: low quality, clean, and toxic; a document's
source plays no part. The classifier joins two parts, read in one pass: subword embeddings tell low from good quality, and
the strength of words that labels teach as toxic (a few in a long text, which averages would drown) the toxic domain.
Posteriors stand as they are, however small a share. Document rates r >= 0 (how often a document is taken, on average) then solve

    minimise  1/2 * sum over domains d of (sum_i r_i n_i p_id - T_d)^2 / T_d

by projected gradient descent from r = 1, where n are tokens, p posteriors and T target token totals. In the metric that
weighs documents by their tokens, a step is r_i <- clip(r_i - <q_i, g>), with one vector g of a value for each domain and
iteration; so a rate is a fold of its document's posterior over the vectors so far. The q in it are posteriors to a
thousandth: documents of one q have one rate, and form a class, whose tokens of each domain are summed once, by exact
posteriors. Iterations read the table of classes, each is a few aggregations to a sum for each domain or pair of domains,
and the vectors are all that the driver holds.

A step of one length for all domains is slow where some domain holds many times its target. So each step is first scaled by
the domains' own curvature over the documents that no limit holds, which meets the targets at once if no rate comes to a
limit; where that doesn't lower the objective, the unscaled step does. Iterations end when every domain is within `close` of its
target, or when neither step gains any more; what then is missing is part of the result, and logged as a warning.

Targets may be out of reach: no rates give 2 % toxic tokens if the classifier finds each document toxic with 6 %, as it
does when a few dozen labels are all it has.

Rounding takes floor(r + u) copies, u in [0, 1) a hash of id and text: the expected totals are the fitted ones, and a task
that runs again takes the same.

A domain without tokens can't be met and doesn't count. Nulls: a null text has no tokens and gets the class odds as its
posterior; null ids are hashed as nulls. Repeated rows get the same rate and the same copies each. Empty tables give empty
results. Extra columns stay; columns named `scored`, `rate` or `copies` are replaced, one named `rid` is dropped.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, cut, give_back, read, row_id
from .samples import labelled_sample
from .subword import SCORED, Model, Scorer, train
from .toxicity import INSULTS, Grammar, bare, beginnings, fit_curve, learn

#: Domains that the labelled table tells apart, and their target shares of tokens.
DOMAINS = ("low", "clean", "toxic")
WEIGHTS = {"low": 0.04, "clean": 0.94, "toxic": 0.02}
#: Posteriors are told apart to one over this much when rates are fitted: a bound to the number of classes.
PARTS = 1000


def domain_of() -> Column:
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality").isNotNull(), F.col("quality"))


@dataclass(frozen=True)
class Classifier:
    quality: Model
    lexicon: dict[str, float]
    curve: tuple[float, float, float]


def strength_of(lexicon: dict[str, float]):
    """A word's strength as a toxic one; words whose first letters begin no key are passed over at once."""
    heads = {k[:3] for k in lexicon}

    def strength(raw: bytes) -> float:
        word = bare(raw.decode())
        return max((lexicon.get(k, 0.0) for k in beginnings(word)), default=0.0) if word[:3] in heads else 0.0

    return strength


def fit_classifier(docs: DataFrame, labels: DataFrame) -> Classifier:
    texts, y = labelled_sample(docs, labels.select("doc_id", domain_of().alias("y")), rows=3000)
    toxic = [int(d == 2) for d in y]
    lexicon = dict.fromkeys(INSULTS, 1.0) | learn(texts, toxic)[0]
    clean = [k for k, d in enumerate(y) if d != 2]
    quality = train([texts[k] for k in clean], [y[k] for k in clean], 2)
    strength = strength_of(lexicon)
    known: dict[bytes, float] = {}
    weights, words = [], []
    for text in texts:
        found = text.encode().split()
        weights.append(sum(known[w] if w in known else known.setdefault(w, strength(w)) for w in found))
        words.append(len(found))
    curve = fit_curve(weights, words, toxic) if len(set(toxic)) == 2 else Grammar.curve
    return Classifier(quality, lexicon, curve)


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """`docs` with scored: a struct of p (the posterior of each of DOMAINS) and n_words. The model's size has a bound of its own."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(SCORED)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        model = held.value
        scorer = Scorer(model.quality, strength_of(model.lexicon))
        a, b, c = model.curve
        for text in batches:
            q, n, w = scorer.score(as_bytes(text))
            toxic = 1 / (1 + np.exp(-np.minimum(30.0, a + b * np.log1p(w) + c * np.minimum(10.0, 100 * w / np.maximum(1, n)))))
            p = np.stack([(1 - toxic) * q[:, 0], (1 - toxic) * q[:, 1], toxic], axis=1)
            ends = pa.array(np.arange(0, p.size + 1, len(DOMAINS), dtype=np.int32))
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(p.ravel())), pa.array(n)], fields=[pa.field("p", pa.list_(pa.float64())), pa.field("n_words", pa.int64())])

    return docs.drop("scored").withColumn("scored", scored("text"))


@dataclass(frozen=True)
class Fit:
    """steps: what `rate_of` folds; missing: of each domain with a target, the part of it that is missed (above: positive)."""

    steps: list[list[float]]
    missing: dict[str, float]


def coarse(p: Column) -> list[Column]:
    """A posterior to a part in PARTS."""
    return [F.round(F.element_at(p, k + 1) * PARTS) / PARTS for k in range(len(DOMAINS))]


def rate_of(fitted: Fit, most: float | None, q: list[Column] | None = None) -> Column:
    """The fold: from 1, clip(r - <q, g>) for each step's g."""
    if not fitted.steps:
        return F.lit(1.0)
    q = q or coarse(F.col("scored.p"))
    table = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in fitted.steps])
    dot = lambda g: sum((x * F.element_at(g, k + 1) for k, x in enumerate(q)), F.lit(0.0))
    top = F.lit(float("inf") if most is None else float(most))
    return F.aggregate(table, F.lit(1.0), lambda r, g: F.least(top, F.greatest(F.lit(0.0), r - dot(g))))


def fit_rates(rows: DataFrame, weights: dict[str, float], anchor: str | None = None, most: float | None = None, rounds: int = 100, close: float = 1e-3, slack: float = 1.02) -> Fit:
    """Steps of the descent, and what they miss. `rows` has `scored`.

    One aggregation first sums the tokens of documents of one class: the iterations read that table, of at most about
    PARTS^2 / 2 rows however many documents there are.

    The total is the corpus's own, or, with an anchor, what keeps that domain's tokens; times `slack`, so that with rates of
    at most 1 the anchor's documents end at 1.
    """
    each = range(len(DOMAINS))
    n, p = F.col("scored.n_words"), [F.element_at(F.col("scored.p"), k + 1) for k in each]
    classes = rows.groupBy(*[x.alias(f"q{k}") for k, x in enumerate(coarse(F.col("scored.p")))]).agg(*[F.sum(n * x).alias(f"n{k}") for k, x in enumerate(p)])
    rows = cut(classes.coalesce(8), "mixing-classes")
    q, tokens = [F.col(f"q{k}") for k in each], [F.col(f"n{k}") for k in each]
    some = lambda *xs: np.array([float(v or 0) for v in rows.agg(*[F.sum(x) for x in xs]).first()])
    held = some(*tokens)
    share = np.array([weights.get(d, 0.0) for d in DOMAINS]) * (held > 0)
    if not share.sum():
        return Fit([], {})
    share = share / share.sum()
    k = DOMAINS.index(anchor) if anchor else -1
    total = slack * held[k] / share[k] if anchor and share[k] else held.sum()
    target = share * total
    live = target > 0
    root = np.sqrt(np.where(live, target, 1.0))
    top = float("inf") if most is None else float(most)

    def curvature(free: Column) -> np.ndarray:
        return some(*[F.when(free, a * b) for a in tokens for b in q]).reshape(len(DOMAINS), -1) / np.outer(root, root) * np.outer(live, live)

    def short(got: np.ndarray) -> np.ndarray:
        return np.where(live, (got - target) / root, 0.0)

    def ended(steps: list[list[float]], got: np.ndarray) -> Fit:
        missing = {d: round(float(x), 6) for d, x, on in zip(DOMAINS, short(got) / root, live, strict=True) if on}
        if max(map(abs, missing.values())) >= close:
            logging.getLogger(__name__).warning("mixing ends %d steps from r = 1 with targets missed by these parts of them: %s", len(steps), missing)
        return Fit(steps, missing)

    first = curvature(F.lit(True))
    step = 1 / max(np.abs(np.linalg.eigvals(first)).max(), 1e-12)
    steps: list[list[float]] = []
    got = held
    for _ in range(rounds):
        left = short(got)
        if np.abs(left / root).max() < close:
            break
        plain = step * left / root
        rate, move = rate_of(Fit(steps, {}), most, q), sum((x * float(g) for x, g in zip(q, plain, strict=True)), F.lit(0.0))
        free = curvature(((rate > 0) | (move < 0)) & ((rate < top) | (move > 0))) if steps else first
        best = None
        for new in (np.linalg.pinv(free, rcond=1e-9) @ left / root, plain):
            trial = [*steps, [round(float(x), 9) for x in new]]
            now = some(*[rate_of(Fit(trial, {}), most, q) * x for x in tokens])
            if best is None or (short(now) ** 2).sum() < (short(best[1]) ** 2).sum():
                best = trial, now
            if (short(now) ** 2).sum() < (left**2).sum() / 2:
                break
        if (short(best[1]) ** 2).sum() > (left**2).sum() * (1 - 1e-3):
            break
        steps, got = best
    return ended(steps, got)


def copies(rate: Column) -> Column:
    return F.floor(rate + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))).cast("int")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, anchor: str | None = None, most: float | None = None) -> DataFrame:
    """`docs` with scored (p, n_words), rate and copies. Posteriors are taken once, and stored without texts for the fit."""
    docs = docs.drop("scored", "rate", "copies", "rid")
    model = fit_classifier(docs, labels)
    rid = row_id("doc_id", "text").alias("rid")
    rows = cut(posteriors(docs.select("doc_id", "text"), model).select(rid, "scored"), "mixing-posteriors")
    fitted = fit_rates(rows, weights or WEIGHTS, anchor, most)
    found = rows.select("rid", "scored", rate_of(fitted, most).alias("rate")).dropDuplicates(["rid"])
    out = docs.withColumn("rid", row_id("doc_id", "text")).join(found, "rid", "left").drop("rid")
    return out.withColumn("copies", copies(F.col("rate")))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_classifier(docs, read(spark, sf_dir, "labels"))
    sized = F.floor(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))).alias("draw")
    rows = cut(posteriors(docs, model).select("doc_id", "scored", sized), "mixing-posteriors")
    rate = rate_of(fit_rates(rows, WEIGHTS), None)
    p = [F.element_at(F.col("scored.p"), k + 1).alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return rows.select("doc_id", F.col("scored.n_words").alias("n_tokens"), *p, F.round(rate, 6).alias("rate"), F.floor(rate + F.col("draw") / F.lit(float(1 << 20))).cast("int").alias("copies"))
