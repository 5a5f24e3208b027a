"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: INSULT, THREAT, TARGET, NEGATION, REPORT, or OTHER. Five small transducers read a clause:

* insult: gives weight at its symbol; a target that follows in the clause adds to it;
* threat: gives nothing by itself; its weight falls due when a target follows within a few words ("I will kill you"), or
  when it ends a clause that named one ("you I will kill"), and lapses otherwise ("they stab at the answer");
* target: remembers that somebody was named, which makes insults after it weigh more;
* negation: a scope of a few words, in which weights count for less;
* reported speech: halves weights that follow in the clause, and those before ("idiot, he said").

Composed, they are one deterministic table (state, symbol) -> (state, scale, weight, dues): `scale` multiplies what the
clause has so far. A document's clauses run through it, and what counts is the matched clause.

The symbols have a few fixed words, and labelled rows teach more of all five kinds (`learn_lexicon`, `learn_context`). A
logistic curve over the document's weight is fitted on the same bounded sample (samples.py; near copies in it count once
for words). Without labels the fixed words and a default curve stand.

Nulls: null and empty texts have no clause and get the curve's base. Very long texts run in memory in proportion to their
words. Repeated rows are scored each; equal texts have equal scores, there are no ties to break. A null id is as good as
any, and counts as held out in the query. Empty tables give empty results. Extra columns stay; `toxicity` is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from math import ceil, log, prod, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import bound_batches, crc32_of_id, read
from .samples import labelled_sample

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: END is read after a clause's last word.
END = 6
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END)

# Fixed words of the grammar.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "trash", "pathetic", "worthless", "loser", "losers", "clown", "disgusting")
THREATS = ("kill", "murder", "strangle", "stab")
TARGETS = ("you", "your", "yours", "yourself", "he", "she", "her", "they", "them", "him", "u")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "wasn't", "don't", "nobody", "kein", "nicht", "pas", "jamais", "nunca")
REPORTS = ("said", "says", "say", "called", "quoted", "wrote", "reported", "allegedly", "according")

FIXED = {w: s for words, s in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}

CLAUSE = re.compile(r"[.!?;\n]+(?=\s|$)")
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
REMEMBERED = 300_000
#: Lengths of word beginnings that may be learned.
STEMS = range(3, 9)


#: What a machine's move does with the weight it is owed: nothing, take it, or lose it.
KEEP, PAY, LAPSE = range(3)


@dataclass(frozen=True)
class Machine:
    """moves: (state, symbol) -> state, others stay; factor: of a state, for weights given in it; gives: weights of symbols.

    owes: weights of symbols that fall due later; settles: what moves do with them. scales: of moves, for the clause so far.
    """

    moves: dict[tuple[int, int], int]
    factor: dict[int, float] = field(default_factory=dict)
    gives: dict[tuple[int, int], float] = field(default_factory=dict)
    owes: dict[tuple[int, int], float] = field(default_factory=dict)
    settles: dict[tuple[int, int], int] = field(default_factory=dict)
    scales: dict[tuple[int, int], float] = field(default_factory=dict)


def counting(opened_by: int, reach: int) -> dict[tuple[int, int], int]:
    """Moves of states k > 0: within the next k words after `opened_by`."""
    return {(k, s): k - 1 for k in range(1, reach + 1) for s in SYMBOLS} | {(k, opened_by): reach for k in range(reach + 1)}


#: Words within which a negation holds, and within which a threat's target follows.
NEGATED, THREATENED = 3, 6


def grammar() -> list[Machine]:
    insult = Machine(
        {(0, TARGET): 1, (0, INSULT): 2, (2, TARGET): 1},  # 1: a target is known; 2: insults wait for one
        gives={(k, INSULT): 1.0 for k in range(3)},
        owes={(0, INSULT): 0.5, (2, INSULT): 0.5},
        settles={(2, TARGET): PAY},
    )
    named, full = THREATENED + 1, THREATENED  # states k: a threat k words from lapsing; named + k: and a target was named before
    moves, owes, settles = {}, {}, {}
    for k in range(THREATENED + 1):
        for state in (k, named + k):
            moves |= {(state, s): state - (k > 0) for s in SYMBOLS} | {(state, THREAT): state - k + full, (state, TARGET): named}
            owes[state, THREAT] = 2.25 if state < named else 1.5  # the target machine's factor makes both the same
            settles |= {(state, s): LAPSE for s in SYMBOLS if k == 1} | {(state, TARGET): PAY}
    settles[named + full, END] = PAY
    threat = Machine(moves, owes=owes, settles=settles)
    target = Machine({(0, TARGET): 1}, factor={1: 1.5})
    negation = Machine(counting(NEGATION, NEGATED), factor=dict.fromkeys(range(1, NEGATED + 1), 0.4))
    reported = Machine({(0, REPORT): 1}, factor={1: 0.5}, scales={(0, REPORT): 0.5})
    return [insult, threat, target, negation, reported]


@dataclass(frozen=True)
class Arc:
    to: int
    scale: float
    gives: float
    #: (owed, settles) of each machine.
    dues: tuple[tuple[float, int], ...]


def compose(machines: list[Machine]) -> list[list[Arc]]:
    """The product machine, reachable states alone: [state][symbol] -> arc.

    A symbol's weight is the sum of what the machines give, times the factors of the states that read it; so is what is owed.
    """
    at = {(0,) * len(machines): 0}
    todo, table = list(at), []
    while todo:
        state = todo.pop(0)
        row = []
        for symbol in SYMBOLS:
            moves = [(k, symbol) for k in state]
            new = tuple(m.moves.get(x, x[0]) for m, x in zip(machines, moves, strict=True))
            if new not in at:
                at[new] = len(at)
                todo.append(new)
            factor = prod(m.factor.get(k, 1.0) for m, k in zip(machines, state, strict=True))
            pairs = list(zip(machines, moves, strict=True))
            dues = tuple((factor * m.owes.get(x, 0.0), m.settles.get(x, KEEP)) for m, x in pairs if m.owes)
            row.append(Arc(at[new], prod(m.scales.get(x, 1.0) for m, x in pairs), factor * sum(m.gives.get(x, 0.0) for m, x in pairs), dues))
        table.append(row)
    return table


def bare(word: str) -> str:
    return word.lower() if word.isalpha() else EDGES.sub("", word).lower()


class Bare(dict):
    """`bare` of words met before."""

    def __missing__(self, word: str) -> str:
        self[word] = plain = bare(word)
        return plain


def beginnings(word: str) -> list[str]:
    """The word itself, and its beginnings marked by a star."""
    return [word, *[word[:k] + "*" for k in STEMS if k < len(word)]]


def thinned(texts: list[str], y: list[int]) -> list[tuple[str, int]]:
    """Texts and labels without near copies: of texts that share their least or their greatest hash of three words, the first."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, label in zip(texts, y, strict=True):
        words = text.split()
        codes = [zlib.crc32(" ".join(w).encode()) for w in zip(words, words[1:], words[2:], strict=False)] or [zlib.crc32(text.encode())]
        marks = {(0, min(codes)), (1, max(codes))}
        if not marks & seen:
            out.append((text, label))
        seen |= marks
    return out


def least_finds(keys: int, rate: float, chance: float) -> int:
    """So many texts of one label (a part `rate` of all) share one of `keys` keys, and none of the other has it, by chance under `chance`."""
    return max(3, ceil(log(max(keys, 2) / chance) / -log(rate)))


#: Texts without near copies, each with its words (without edges, lower case) by clauses, and its label.
Read = list[tuple[list[list[str]], int]]


def read_clauses(texts: list[str], y: list[int]) -> Read:
    plain = Bare()
    return [([[p for w in c.split() if (p := plain[w])] for c in CLAUSE.split(text)], label) for text, label in thinned(texts, y)]


def learn_lexicon(read_: Read, known: dict[str, float], taken: dict[str, int], strict: bool, chance: float = 0.05) -> dict[str, float]:
    """Words and beginnings that chance doesn't explain, with their strength: (precision - rate) / (1 - rate), squared.

    Of n keys, one that is in k texts, all toxic, by chance has odds of n * rate^k; a key needs such a k with odds under
    `chance`, and two more for each text that isn't toxic; or, where not strict, twice that k, and to be toxic more often
    than not, and than chance explains. A beginning gives way to longer ones that are as frequent, and covers the rest.
    Words with a symbol in `taken`, or under a key of `known`, say nothing; nor do clauses with a negation or report there,
    which were learned because they turn insults harmless.
    """
    turned = {w for w, s in taken.items() if s in (NEGATION, REPORT) and w not in FIXED}
    rows = [(set().union(*(c for c in clauses if turned.isdisjoint(c))) - taken.keys() - FIXED.keys(), label) for clauses, label in read_]
    toxic = sum(label for _, label in rows)
    if not toxic or toxic == len(rows):
        return {}
    rate = toxic / len(rows)
    own = {w: x for w in set().union(*(words for words, _ in rows)) if len(w) > 2 and known.keys().isdisjoint(x := beginnings(w))}
    keys = len(set(chain.from_iterable(own.values())))
    least = least_finds(keys, rate, chance)
    none: list[str] = []

    def count(label: int) -> Counter:
        return Counter(chain.from_iterable(set(chain.from_iterable(own.get(w, none) for w in words)) for words, y in rows if y == label))

    bad = {k: n for k, n in count(1).items() if n >= least}
    own = {w: found for w, x in own.items() if (found := [k for k in x if k in bad])}  # the others can't be found
    good = count(0)
    if strict:
        new = {k for k, n in bad.items() if n >= least + 2 * good[k] and n >= 9 * good[k]}
    else:
        z = sqrt(2 * log(max(keys, 2) / chance))  # chance alone stays within so many deviations for every key
        part = lambda n: max(0.5, rate + z * sqrt(rate * (1 - rate) / n))
        new = {k for k, n in bad.items() if n >= 2 * least and n > (n + good[k]) * part(n + good[k])}
    for key in sorted(new, key=lambda k: (len(k), k)):
        if key in new and key.endswith("*"):
            longer = {k for k in new if k != key and k.startswith(key[:-1])}
            if any(bad[k] >= 0.9 * bad[key] for k in longer):
                new.discard(key)
            else:
                new -= longer
    return {k: ((bad[k] / (bad[k] + good[k]) - rate) / (1 - rate)) ** 2 for k in new}


def learn(texts: list[str], y: list[int]) -> tuple[dict[str, float], dict[str, int]]:
    """(lexicon, context): sure insults first, then words of the other symbols by their company, then weaker insults."""
    found = read_clauses(texts, y)
    sure = learn_lexicon(found, {}, {}, strict=True)
    context = learn_context(found, sure)
    return sure | learn_lexicon(found, sure, context, strict=False), context


#: Words that a threat and its target are apart at most, to teach each other.
NEAR = 3


#: An insult of this strength says what its neighbours do; what weaker ones stand beside says nothing.
STRONG = 0.8


def learn_context(read_: Read, lexicon: dict[str, float], chance: float = 0.05) -> dict[str, int]:
    """Words for the four other symbols, from the company they keep in clauses.

    * Of texts with an insult, a word that stands just before it in clean ones alone is a NEGATION, one that stands farther
      off or behind it a REPORT.
    * Of texts without an insult, a word that a target follows closely in toxic ones alone is a THREAT, and a word that
      follows a threat closely in toxic ones alone a TARGET. Each needs texts, of the same label, with the one and not the other.

    "Alone" leaves one text in ten; and there must be more of them than chance explains.
    """
    insulting = lexicon | dict.fromkeys(INSULTS, 1.0)
    symbols = dict(FIXED)
    strength = {w: max((insulting.get(k, 0.0) for k in beginnings(w)), default=0.0) for w in set(chain.from_iterable(chain.from_iterable(c for c, _ in read_)))}
    insults = {w for w, n in strength.items() if n >= STRONG}
    with_insult = [(c, label) for c, label in read_ if not insults.isdisjoint(chain.from_iterable(c))]
    without = [(c, label) for c, label in read_ if not any(map(strength.__getitem__, chain.from_iterable(c)))]

    def picked(rows: list[tuple[set[str], int]], label: int, known: dict[str, int]) -> set[str]:
        rate = sum(y == label for _, y in rows) / max(1, len(rows))
        every, own = Counter(), Counter()
        for keys, y_ in rows:
            every.update(keys)
            if y_ == label:
                own.update(keys)
        if not 0 < rate < 1:
            return set()
        least = least_finds(len(every), rate, chance)
        return {k for k, n in own.items() if n >= least + 2 * (every[k] - n) and n >= 0.9 * every[k] and k not in known}

    def around(clauses: list[list[str]], near: bool) -> set[str]:
        keys: set[str] = set()
        for c in clauses:
            places = [k for k, w in enumerate(c) if w in insults]
            before = {j for k in places for j in range(max(0, k - NEGATED), k)}
            keys |= {c[j] for j in (before if near else set(range(len(c))) - before)} if places else set()
        return keys - insults

    negations = picked([(around(c, True), label) for c, label in with_insult], 0, symbols)
    reports = picked([(around(c, False), label) for c, label in with_insult], 0, symbols)
    elsewhere = Counter(w for c, _ in with_insult for w in around(c, False) & negations & reports)
    close = Counter(w for c, _ in with_insult for w in around(c, True) & negations & reports)
    both = {w for w in negations & reports if elsewhere[w] > close[w]}
    symbols |= dict.fromkeys(negations - both, NEGATION) | dict.fromkeys((reports - negations) | both, REPORT)

    def followed(clauses: list[list[str]], symbol: int, forward: bool) -> set[str]:
        """Words that one of `symbol` follows within reach, or that follow one."""
        keys: set[str] = set()
        for c in clauses:
            for k, w in enumerate(c):
                if symbols.get(w) == symbol:
                    keys.update(c[max(0, k - NEAR) : k] if forward else c[k + 1 : k + 1 + NEAR])
        return keys

    for symbol, new, forward in ((TARGET, THREAT, True), (THREAT, TARGET, False)):
        paired = [(followed(c, symbol, forward), label) for c, label in without]
        apart = Counter(w for (c, label), (keys, _) in zip(without, paired, strict=True) if not label for w in {w for x in c for w in x} - keys)
        words = picked(paired, 1, symbols)
        symbols |= {w: new for w in words if apart[w] >= 3}  # clean texts have it too, elsewhere: it is the pair that is toxic
    return {w: s for w, s in symbols.items() if FIXED.get(w) != s}


class Reader:
    """Weights of texts by the composed grammar."""

    def __init__(self, lexicon: dict[str, float], context: dict[str, int] | None = None):
        self.table = [[(a.to, a.scale, a.gives, *[x for due in a.dues for x in due]) for a in row] for row in compose(grammar())]
        self.lexicon = lexicon | dict.fromkeys(INSULTS, 1.0)
        self.fixed = FIXED | (context or {})
        self.known: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        """A word's symbol, and its strength."""
        plain = bare(word)
        strength = max((self.lexicon.get(k, 0.0) for k in beginnings(plain)), default=0.0)
        return (INSULT, strength) if strength else (self.fixed.get(plain, OTHER), 1.0)

    def clause(self, symbols: list[tuple[int, float]]) -> float:
        state, weight, owed_insult, owed_threat = 0, 0.0, 0.0, 0.0
        for symbol, strength in (*symbols, (END, 1.0)):
            state, scale, gives, insult, settle_insult, threat, settle_threat = self.table[state][symbol]
            if settle_insult == PAY:
                weight, owed_insult = weight + owed_insult, 0.0
            if settle_threat:
                weight, owed_threat = weight + (owed_threat if settle_threat == PAY else 0.0), 0.0
            weight = scale * weight + strength * gives
            owed_insult = scale * owed_insult + strength * insult
            owed_threat = scale * owed_threat + strength * threat
        return weight

    def weigh(self, text: str) -> tuple[float, int, int]:
        """(sum of clause weights, matched clauses, words)."""
        known, words = self.known, text.split()
        if len(known) > REMEMBERED:
            known.clear()
        hit = False
        for w in words:
            if (s := known.get(w)) is None:
                known[w] = s = self.symbol(w)
            if s[0] == INSULT or s[0] == THREAT:
                hit = True
        if not hit:
            return 0.0, 0, len(words)
        total, matched = 0.0, 0
        for clause in CLAUSE.split(text):
            symbols = [known.get(w) or self.symbol(w) for w in clause.split()]
            if any(s == INSULT or s == THREAT for s, _ in symbols):
                weight = self.clause(symbols)
                total += weight
                matched += weight > 0
        return total, matched, len(words)


@dataclass(frozen=True)
class Grammar:
    #: Learned keys and their strengths.
    lexicon: dict[str, float]
    #: Learned words of the other symbols.
    context: dict[str, int] = field(default_factory=dict)
    #: Of 1, log(1 + weight), weight for each hundred words.
    curve: tuple[float, float, float] = (-3.0, 6.0, 0.5)

    def score(self, weight: float, words: int) -> float:
        a, b, c = self.curve
        return round(1 / (1 + float(np.exp(-min(30.0, a + b * log(1 + weight) + c * min(10.0, 100 * weight / max(1, words)))))), 6)


def fit(texts: list[str], y: list[int], rounds: int = 800) -> Grammar:
    if len(set(y)) < 2:
        return Grammar({})
    lexicon, context = learn(texts, y)
    reader = Reader(lexicon, context)
    read_ = [reader.weigh(t) for t in texts]
    return Grammar(lexicon, context, fit_curve([w for w, _, _ in read_], [n for _, _, n in read_], y, rounds))


def fit_curve(weights: list[float], words: list[int], y: list[int], rounds: int = 800) -> tuple[float, float, float]:
    x = np.array([(1.0, log(1 + w), min(10.0, 100 * w / max(1, n))) for w, n in zip(weights, words, strict=True)])
    default = np.array(Grammar.curve)
    target, curve = np.asarray(y, float), default.copy()
    for _ in range(rounds):  # weights of evidence stay positive: the lexicon alone says what is toxic
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        curve -= 0.5 * (x.T @ (p - target) / len(target) + 1e-3 * (curve - default))
        curve[1:] = np.maximum(curve[1:], 0.1)
    return tuple(float(v) for v in curve)


WEIGHED = StructType([StructField("score", DoubleType()), StructField("weight", DoubleType()), StructField("clauses", LongType())])


def score_toxicity(docs: DataFrame, model: Grammar) -> DataFrame:
    """`docs` with toxicity: a struct of score, the clauses' weight, and the number of matched clauses."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf(WEIGHED)
    def weighed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(model.lexicon, model.context)
        for batch in batches:
            rows = [reader.weigh(t or "") for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([model.score(w, n) for w, _, n in rows], pa.float64()), pa.array([w for w, _, _ in rows], pa.float64()), pa.array([c for _, c, _ in rows], pa.int64())],
                names=["score", "weight", "clauses"],
            )

    return docs.drop("toxicity").withColumn("toxicity", weighed("text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.pmod(crc32_of_id(), F.lit(5)) == 0, F.lit(True))
    texts, y = labelled_sample(docs, read(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("toxic").alias("y")), rows=5000)
    score = F.col("toxicity.score")
    return score_toxicity(docs, fit(texts, y)).select("doc_id", held.alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"), "toxicity.clauses")
