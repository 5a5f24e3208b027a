"""Phrases whose words occur together more often than apart, counted in suffix subtrees of a partition by prefixes.

The suffixes of all pieces of text, cut to `most` words, make one tree for each language; a phrase's count is the total of
the leaves below it. The tree is built in parts (the vertical partitioning of ERA, Mansour et al. 2011). Words, and runs of
them, are counted first; each word is the prefix of a subtree, and one with more suffixes than the memory budget is extended
by its second word, and so on. Prefixes that occur fewer than `least` times have no subtree: leaves end before a word, or a
run of words, that is so rare. Each task counts equal leaves before they are sent. Leaves go by prefix to partitions, where
those of a prefix lie together and in order; prefixes are grouped, as many as fit the budget, and a group's subtrees are
built, read from their leaves up, and dropped, whatever the other groups hold. A node above its prefixes, up to a language's
root with all its words, is the sum of what their groups say of it.

The budget grows only where the corpus has over `BUDGET` x `PREFIXES` words, so that no more than `PREFIXES` prefixes of a
level are ever extended: that is what tasks get as a whole, with a bitmap of bounded size for each level's prefixes of `least` or
more. Prefixes are known by 64 bits there; one that is taken for frequent or full by chance costs rows, not results. Counts of phrases' parts are joined: those of parts with more than a
thousandth of all words, at most a thousand for each level, are broadcast, and of any other part no more than a
ten-thousandth of all words can be candidates. Nothing is capped or sampled; the first `top` of a language are chosen in two steps.

Null texts are empty, null languages `und`, and a piece without words counts for nothing. Repeated rows count as often as they
occur. Very long texts are read whole. Scores are exact (decimals of 38 digits); ties go by count, then by the bytes
of the phrase. Empty tables give no rows. Columns other than text and lang are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, cut, read, release, slices

MOST, LEAST, INSIDE, TOP = 3, 10, 50, 2000
#: Leaves of a group of subtrees in memory; most prefixes of a level that are extended; a task's words before it hands on their counts.
BUDGET, PREFIXES, HELD = 250_000, 50_000, 1_000_000
#: A bitmap of frequent prefixes has at most 2^BITS bits: 16 MB.
BITS = 27
#: Parts with so many words in all, or more, are broadcast: a thousand for each level at most.
COMMON = 1000
#: Shares of a language that are ranked by themselves first.
SPREAD = 64

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENDS = ".,;:!?\n\x0b\x0c\r"
#: Stands between pieces, and for what no leaf goes beyond; no word holds it.
END = b"."
_FOLD = bytes.maketrans((UPPER + ENDS).encode(), UPPER.lower().encode() + END * len(ENDS))

def word_list(text: bytes) -> list[bytes]:
    """The words of all pieces, and END where a piece ends; no white space but spaces and tabs is left to split at."""
    return text.translate(_FOLD).replace(END, b" . ").split()


class Bits:
    """A bitmap of the hashes that occur at least `least` times, of rows (h, c)."""

    def __init__(self, counts: DataFrame, least: int, most_bits: int = BITS):
        often = counts.where(F.col("c") >= least)
        self.size = min(most_bits, max(6, (8 * often.count()).bit_length()))
        at = F.col("h").bitwiseAND((1 << self.size) - 1)
        ones = often.select(F.shiftright(at, 6).alias("row"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bit"))
        got = ones.groupBy("row").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^BITS / 64 rows at most
        rows = np.zeros(1 << (self.size - 6), np.int64)
        rows[got.column("row").to_numpy()] = got.column("bits").to_numpy()
        self.packed = zlib.compress(rows.tobytes())
        self.rows: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": None}

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.rows is None:
            self.rows = np.frombuffer(zlib.decompress(self.packed), np.uint64)
        at = h & np.uint64((1 << self.size) - 1)
        return self.rows[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1


class Numbers(dict):
    """Numbers of a language's words in a task, from 1 on, with a hash of each. END is 0."""

    def __init__(self, lang: str):
        super().__init__({END: 0})
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        self.words, self.hashes = [b""], [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return number

    def strings(self, at: np.ndarray) -> pa.Array:
        return pa.array(self.words, pa.binary()).cast(pa.string()).take(pa.array(at))

    def hash_of(self, columns: list[np.ndarray]) -> np.ndarray:
        """64 bits for each row's words."""
        h = np.zeros(len(columns[0]), np.uint64)
        known = np.array(self.hashes, np.uint64)
        for w in columns:
            h = (h ^ known[w]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h


def windows(numbers: np.ndarray, size: int) -> list[np.ndarray]:
    """Of each place the next `size` numbers, 0 from an END on."""
    out = [numbers]
    for k in range(1, size):
        out.append(np.where(out[-1] == 0, 0, np.append(numbers[k:], np.zeros(min(k, len(numbers)), numbers.dtype))))
    return out


def distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first, count) of each distinct row of numbers, in order."""
    code = columns[0].astype(np.int64)
    base = max((int(w.max(initial=0)) for w in columns), default=0) + 1
    for k, w in enumerate(columns[1:], 2):
        code = code * base + w
        if k < len(columns):
            code = np.unique(code, return_inverse=True)[1]  # codes are places at most, so that no key passes 63 bits
    _, at, count = np.unique(code, return_index=True, return_counts=True)
    return at, count


Counted = Callable[[str, np.ndarray, Numbers], dict[str, pa.Array]]


def _counted(docs: DataFrame, of: Counted, schema: str) -> DataFrame:
    """What `of` counts in the numbered words of a language, for some `HELD` words of a task at a time."""
    bound_batches(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Numbers] = {}
        held: dict[str, list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                found = of(lang, np.concatenate(parts), known[lang])
                for k in range(0, len(found["c"]), 50_000):
                    some = [found[name].slice(k, 50_000) for name in names[1:]]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some[0])), *some], names=names)
            held.clear()
            if sum(map(len, known.values())) > HELD:
                known.clear()

        for batch in slices(batches, 64):
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if lang not in known:
                    known[lang] = Numbers(lang)
                numbers = list(map(known[lang].__getitem__, word_list(text)))
                held.setdefault(lang, []).append(np.array([*numbers, 0], np.int64))
            if sum(len(x) for parts in held.values() for x in parts) > HELD:
                yield from out()
        yield from out()

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, schema)


def run_counts(docs: DataFrame, most: int) -> DataFrame:
    """(size, h, c) of all runs of fewer than `most` words of all languages, by their hashes alone."""

    def of(_: str, numbers: np.ndarray, known: Numbers) -> dict[str, pa.Array]:
        size, h, c = [], [], []
        for k in range(1, most):
            columns = windows(numbers, k)
            there = columns[-1] != 0
            columns = [w[there] for w in columns]
            at, count = distinct(columns)
            size.append(np.full(len(at), k))
            h.append(known.hash_of([w[at] for w in columns]).view(np.int64))
            c.append(count)
        return {"size": pa.array(np.concatenate(size)), "h": pa.array(np.concatenate(h)), "c": pa.array(np.concatenate(c))}

    return _counted(docs, of, "lang string, size long, h long, c long").groupBy("size", "h").agg(F.sum("c").alias("c"))


def frequent(numbers: np.ndarray, known: Numbers, size: int, levels: list[Bits]) -> list[np.ndarray]:
    """Each place's next words up to `size`, 0 from where a run of them is too rare for `levels`, or a piece ends."""
    columns = windows(numbers, size)
    fine = []
    for k, bits in enumerate(levels, 1):  # whether the k words from a place on may be frequent
        run = columns[:k] if k <= size else windows(numbers, k)
        fine.append((run[-1] != 0) & bits.has(known.hash_of(run)))
    out = []
    ok = np.ones(len(numbers), bool)
    for k, w in enumerate(columns, 1):
        if m := min(k, len(levels)):  # the last m words of the k
            shift = k - m
            ok = ok & np.append(fine[m - 1][shift:], np.zeros(min(shift, len(numbers)), bool))
        out.append(np.where(ok, w, 0))
    return out


def partitioned(runs: DataFrame, most: int, least: int, budget: int) -> tuple[list[Bits], list[np.ndarray]]:
    """For each level of prefixes, those that are frequent, and (by their hashes) those that more than `budget` suffixes begin with."""
    levels: list[Bits] = []
    full: list[np.ndarray] = []
    for size in range(1, most):
        counts = runs.where(F.col("size") == size)
        over = counts.where(F.col("c") > budget).select("h").toArrow().column("h")  # at most all words / budget
        full.append(np.unique(over.to_numpy().view(np.uint64)))
        levels.append(Bits(counts, least))
    return levels, full


def _leaves(docs: DataFrame, most: int, levels: list[Bits], full: list[np.ndarray]) -> DataFrame:
    """(lang, leaf, depth, c): a leaf's `most` words, with empty ones beyond its end; the first `depth` are its prefix.

    Suffixes that begin with a rare word are a leaf without words, so that all of a language add up to its words.
    """

    def of(lang: str, numbers: np.ndarray, known: Numbers) -> dict[str, pa.Array]:
        columns = frequent(numbers, known, most, levels)
        begins = columns[0] != 0
        columns = [w[begins] for w in columns]
        at, count = distinct(columns)  # in the order of their words' numbers: rows that are alike lie together where they are packed
        columns = [w[at] for w in columns]
        depth, deeper = np.ones(len(at), np.int64), np.ones(len(at), bool)
        for k, over in enumerate(full, 1):
            deeper = deeper & (columns[k - 1] != 0) & np.isin(known.hash_of(columns[:k]), over)
            depth[deeper] = k + 1
        rare = int((numbers != 0).sum() - begins.sum())
        columns, depth, count = [np.append(w, 0) for w in columns], np.append(depth, 1), np.append(count, rare)
        return {"leaf": pc.binary_join_element_wise(*(known.strings(w) for w in columns), " "), "depth": pa.array(depth), "c": pa.array(count)}

    return _counted(docs, of, "lang string, leaf string, depth long, c long")


class Subtrees:
    """The subtrees of a group of prefixes: leaves in order, and for each level the places where its nodes begin."""

    def __init__(self, leaves: pa.Table, most: int):
        self.lang = leaves.column("lang").combine_chunks()
        self.count, self.depth = (leaves.column(x).to_numpy() for x in ("c", "depth"))
        n = leaves.num_rows
        words = pc.list_flatten(pc.split_pattern(leaves.column("leaf").combine_chunks(), " "))
        self.words = [words.take(pa.array(np.arange(k, n * most, most))) for k in range(most)]
        changes = lambda x: np.append(True, pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False))
        self.roots = leaves.group_by("lang").aggregate([("c", "sum")])
        begins = changes(self.lang)
        self.begins = []
        for w in self.words:
            begins = begins | changes(w)
            self.begins.append(begins)

    def last_prefix(self) -> int:
        """Where the last prefix begins."""
        begin = np.choose(self.depth - 1, self.begins)
        return int(np.flatnonzero(begin)[-1])

    def nodes(self, least: int) -> Iterator[pa.RecordBatch]:
        """Of each level, nodes whose leaves add up to at least `least`, and all that other groups have a part of; each language's root."""
        for lang, total in zip(*(self.roots.column(x).to_pylist() for x in ("lang", "c_sum")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([total])], names=["lang", "n_words", "phrase", "f"])
        for k, begins in enumerate(self.begins):
            at = np.flatnonzero(begins)
            total = np.add.reduceat(self.count, at)
            there = pc.not_equal(self.words[k], "").to_numpy(zero_copy_only=False)[at]
            told = there & ((total >= least) | (self.depth[at] > k + 1))
            at, total = pa.array(at[told]), pa.array(total[told])
            phrase = pc.binary_join_element_wise(*(w.take(at) for w in self.words[: k + 1]), " ")
            yield pa.RecordBatch.from_arrays([self.lang.take(at), pa.array(np.full(len(at), k + 1, np.int32)), phrase, total], names=["lang", "n_words", "phrase", "f"])


def nodes(docs: DataFrame, runs: DataFrame, most: int, least: int, budget: int) -> DataFrame:
    """(lang, n_words, phrase, f) of the nodes of all languages' trees that at least `least` suffixes begin with, and of the roots."""
    levels, full = partitioned(runs, most, least, budget)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, full = 0, budget
        for batch in slices(batches, 1 << 20):
            held.append(batch)
            rows += batch.num_rows
            if rows > full:
                table = pa.Table.from_batches(held)
                first = Subtrees(table, most).last_prefix()
                if first:
                    yield from Subtrees(table.slice(0, first), most).nodes(least)
                held = table.slice(first).to_batches()
                rows -= first
                full = max(budget, 2 * rows)  # a prefix may be longer than a batch, though not than the budget
        if rows:
            yield from Subtrees(pa.Table.from_batches(held), most).nodes(least)

    leaves = _leaves(docs, most, levels, full)
    ordered = leaves.repartition("lang", F.expr("substring_index(leaf, ' ', int(depth))")).sortWithinPartitions("lang", "leaf")
    found = ordered.mapInArrow(build, "lang string, n_words int, phrase string, f long")
    return found.groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("n_words") == 0))


def _part(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("w", first, size), " ")


def _looked_up(rows: DataFrame, part: str, name: str, known: DataFrame, common: DataFrame) -> DataFrame:
    """`rows` with the count of their `part`: of a common one by broadcast, of another by a join that common ones stay out of."""
    rows = rows.join(F.broadcast(common.select("lang", F.col("phrase").alias(part), F.col("f").alias("_common"))), ["lang", part], "left")
    away = F.concat(F.lit(" "), "phrase")  # begins with a space, as no phrase does
    rows = rows.withColumn("_key", F.when(F.col("_common").isNull(), F.col(part)).otherwise(away))
    found = rows.join(known.select("lang", F.col("phrase").alias("_key"), F.col("f").alias("_known")), ["lang", "_key"], "left")
    return found.withColumn(name, F.coalesce("_common", "_known")).drop("_common", "_known", "_key")


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, inside: int = INSIDE, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `most` words."""
    spark = docs.sparkSession
    runs = cut(run_counts(docs, most), "runs")
    total = runs.where("size = 1").agg(F.sum("c")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    budget = max(1, total // PREFIXES, min(budget, total // (2 * partitions)))
    tree = cut(nodes(docs, runs, most, least, budget), "nodes")
    release(runs)

    n = tree.where("n_words = 0").select("lang", F.col("f").alias("n"))
    parts = tree.where(F.col("n_words").between(1, most - 1))
    common = parts.where(F.col("f") * COMMON >= total)
    size = F.col("n_words")
    w = F.split("phrase", " ")
    candidates = tree.where(size > 1).select("lang", "n_words", "phrase", F.col("f").alias("a"), w.alias("w"))
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("k"), _part(1, k).alias("left"), _part(k + 1, size - k).alias("right")))).alias("x"))
    cuts = cuts.select("lang", "phrase", "a", "x.*")
    for part, name in (("left", "l"), ("right", "r")):
        cuts = _looked_up(cuts, part, name, parts, common)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", F.lit(1000000).cast("decimal(7,0)") * (wide("a") * wide("a"))).withColumn("below", wide("l") * wide("r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.score", "x.l", "x.r")

    # of a candidate's contiguous parts, those of two words or more may be held by it
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda k: _part(k, m))))
    held = candidates.where(size > 2).select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_held"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.col("_held").isNull() | (100 * F.col("_held") < inside * F.col("a"))).drop("_held")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*order)
    some = kept.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(n), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def phrases_sql(least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> str:
    """The same for phrases of up to three words."""
    return f"""
    WITH pieces AS (
        SELECT row_number() OVER () AS piece_id, lang, piece FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\n\\x0B\\x0C\\r]+')) AS piece FROM documents)),
    lists AS (SELECT piece_id, lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
    words AS (SELECT piece_id, lang, unnest(w) AS w1, unnest(range(len(w))) AS p FROM lists),
    places AS (SELECT lang, w1, w1 || ' ' || lead(w1) OVER o AS w2, w1 || ' ' || lead(w1) OVER o || ' ' || lead(w1, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY piece_id ORDER BY p)),
    f AS MATERIALIZED (
        SELECT lang, 1 AS m, w1 AS phrase, count(*) AS f FROM places GROUP BY ALL
        UNION ALL SELECT lang, 2, w2, count(*) FROM places WHERE w2 IS NOT NULL GROUP BY ALL
        UNION ALL SELECT lang, 3, w3, count(*) FROM places WHERE w3 IS NOT NULL GROUP BY ALL),
    candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= {least}),
    cuts AS (SELECT lang, phrase, a, m, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : m], ' ') AS y FROM candidates, (VALUES (1), (2)) AS ks(k) WHERE k < m),
    scored AS (
        SELECT cuts.lang, cuts.phrase, a, m, arg_min({{'s': s, 'l': l, 'r': r}}, s * 4 + k) AS b FROM (
            SELECT cuts.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS s
            FROM cuts JOIN f AS x ON cuts.lang = x.lang AND cuts.x = x.phrase JOIN f AS y ON cuts.lang = y.lang AND cuts.y = y.phrase) AS cuts GROUP BY ALL),
    held AS (
        SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM candidates WHERE m = 3) GROUP BY ALL)
    SELECT lang, rank, phrase, a, l, r, n, score FROM (
        SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.b.s DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.b.l AS l, s.b.r AS r, totals.n::BIGINT AS n, s.b.s::BIGINT AS score
        FROM scored AS s LEFT JOIN held ON s.lang = held.lang AND s.phrase = held.phrase JOIN (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang) AS totals ON s.lang = totals.lang
        WHERE held.a IS NULL OR 100 * held.a < {inside} * s.a) WHERE rank <= {top}"""


OP12_SQL = phrases_sql()
