"""Near-duplicates by SimHash, found through an index of byte positions with count filtering.

Two fingerprints of 64 bits that differ in at most 3 bits differ in at most 3 of 8 bytes, so they share at least 5 bytes
at the same positions: the guaranteed minimum of matches. Postings of single bytes would be as long as a 256th of all
fingerprints, and their pairs would grow with the square of the input; a posting here is for four positions at once. The
14 blocks of the Steiner system S(3, 4, 8) leave out any three positions with at least one block, so that a linked pair
meets in a posting. For a pair that meets, shared positional bytes are tallied, pairs under five dropped, and the others
verified by their differing bits.

Equal fingerprints are one entry. A posting of more than `most` entries is dealt again by four of the eight nibbles that
its entries may differ in: at most 3 nibbles differ, so the same blocks lose no link, and the new postings fix 48 of 64
bits, so that none ever has more than 65,536 entries. A posting gives a spanning forest of its links, never all pairs.

Joins are sorted ones: whatever grows with the documents is shuffled, and never broadcast through the driver.

Nulls: a null text has no words, fingerprint zero. Rows of equal ids are rows of their own; a component's id is its
smallest doc_id, nulls aside. Equal texts tie and are one group, whatever their order. Empty tables give empty results. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, cut, read, release, row_id, slices
from .components import components

MAX_BITS = 3
#: Entries of a posting above which it is dealt again.
MOST = 2048
BIT_TABLE = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def blocks() -> list[tuple[int, ...]]:
    """S(3, 4, 8): taken in order, each four of eight positions that share at most two with those before."""
    found: list[tuple[int, ...]] = []
    for four in combinations(range(8), 4):
        if all(len(set(four) & set(x)) <= 2 for x in found):
            found.append(four)
    return found


def _masks(width: int) -> list[int]:
    part = (1 << width) - 1
    return [sum(part << (width * k) for k in four) for four in blocks()]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(raw: bytes, size: int, seed: int = 42) -> list[int]:
    """XXH64 of the word shingles of one text, A-Z in lower case, repeats included."""
    words = raw.lower().split()
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprints_of(hashes: list[list[int]]) -> np.ndarray:
    """SimHash of each text's hashes: bits set in over half of them. Votes are counted byte by byte for all texts at once."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(sizes.sum())).view(np.uint8).reshape(-1, 8)
    at = np.repeat(np.arange(len(hashes), dtype=np.int64) * 256, sizes)
    out = np.zeros(len(hashes), np.uint64)
    for k in range(8):
        seen = np.bincount(at + flat[:, k], minlength=256 * len(hashes)).reshape(-1, 256)
        bits = (2 * (seen @ BIT_TABLE) > sizes[:, None]).astype(np.uint64)
        out |= (bits << np.arange(8 * k, 8 * k + 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, size: int = 3, key: str = "doc_id", kind: str = "long") -> DataFrame:
    """(key, fp): fp a signed long."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            fps = fingerprints_of([shingle_hashes(x, size) for x in as_bytes(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    return docs.select(F.col(key).cast(kind).alias(key), "text").mapInArrow(run, f"{key} {kind}, fp long")


def _linked(one: np.ndarray, others: np.ndarray, most: int) -> np.ndarray:
    """Which of `others` are within `most` bits of each of `one`: positional bytes tallied first, then bits."""
    x = one[:, None] ^ others[None, :]
    tally = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2)
    return (tally >= 8 - most) & (np.bitwise_count(x) <= most)


def spanning(entries: np.ndarray, most: int, block: int = 64) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among a posting's distinct entries; a block of the frontier is compared at a time."""
    left, a, b = entries, [], []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            head, frontier = frontier[:block], frontier[block:]
            hit = _linked(head, left, most)
            who = hit.any(axis=0)
            if who.any():
                new = left[who]
                a.append(head[hit[:, who].argmax(axis=0)])
                b.append(new)
                left, frontier = left[~who], np.concatenate((frontier, new))
    return a, b


def postings(fps: DataFrame, most: int = MOST) -> DataFrame:
    """(block, key, sub, fp) of distinct fingerprints, without postings of one entry; sub is 0 where a posting was small enough.

    Sizes are counted in the tasks first and joined back, so that no task ever holds a posting that is still to be dealt again.
    """
    entries = F.array(*[F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(_masks(8))])
    first = fps.select("fp", F.inline(entries))
    sizes = first.groupBy("block", "key").agg(F.count("*").alias("g")).where("g > 1")
    first = first.join(sizes.hint("merge"), ["block", "key"])
    return first.select("block", "key", "fp", F.explode(F.when(F.col("g") <= most, F.array(F.lit(0).cast("long"))).otherwise(_subs())).alias("sub"))


def _subs() -> Column:
    """Keys within a posting: its block leaves four bytes free, which are eight nibbles; 14 times four of those."""
    rows = []
    for four in blocks():
        free = [n for k in range(8) if k not in four for n in (2 * k, 2 * k + 1)]
        rows.append([sum(0xF << (4 * free[k]) for k in sub) for sub in blocks()])
    table = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in rows])
    return F.transform(F.element_at(table, F.col("block") + 1), lambda m, k: F.xxhash64(k + 1, F.col("fp").bitwiseAND(m)))


def links(fps: DataFrame, max_bits: int = MAX_BITS, most: int = MOST) -> DataFrame:
    """(a, b): links among distinct fingerprints, enough of them to connect whatever is connected."""
    if max_bits > 3:
        raise ValueError("the blocks hold for at most 3 differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(k).to_numpy(zero_copy_only=False)).astype(np.int64) for k in range(4)])
            rows = np.concatenate([*held, rows], axis=1) if held else rows
            last = int(np.argmax((rows[:3] == rows[:3, -1:]).all(axis=0)))  # the last posting may go on in the next batch
            held = [rows[:, last:]]
            if last:
                yield of(rows[:, :last])
        if held:
            yield of(held[0])

    def of(rows: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, rows.shape[1]))
        fp, a, b = rows[3].view(np.uint64), [], []
        two = at[sizes == 2]
        x = fp[two] ^ fp[two + 1]
        tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = two[(tally >= 8 - max_bits) & (np.bitwise_count(x) <= max_bits)]
        a.append(fp[near])
        b.append(fp[near + 1])
        for k, n in zip(at[sizes > 2], sizes[sizes > 2], strict=True):
            more = spanning(np.unique(fp[k : k + n]), max_bits)
            a += more[0]
            b += more[1]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])

    met = postings(fps, most).repartition("block", "key", "sub").sortWithinPartitions("block", "key", "sub")
    return met.select("block", "key", "sub", "fp").mapInArrow(run, "a long, b long")


def _components(fps: DataFrame, max_bits: int, most: int) -> DataFrame:
    """(fp, root) of the distinct fingerprints of `fps`: root is the component's smallest fingerprint."""
    first = fps.select("fp").distinct()
    roots = components(links(first, max_bits, most))
    return first.join(roots.hint("merge"), first["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, size: int = 3, max_bits: int = MAX_BITS, most: int = MOST) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    fps = cut(fingerprints(docs, size), "simhash")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = cut(_components(fps, max_bits, most).join(first.hint("merge"), "fp"), "simhash-roots")
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = cut(roots.join(least.hint("merge"), "root").select("fp", "component_id"), "simhash-components")
    release(roots)
    return fps.join(ids.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, size: int = 3, max_bits: int = MAX_BITS, most: int = MOST) -> DataFrame:
    """One row of `docs` for each component: that of the smallest id (nulls last), then of the smallest 128-bit hash of id and text.

    Rows of equal id and text are one. A column of `docs` named rid is dropped.
    """
    rows = docs.withColumn("rid", row_id("doc_id", "text"))
    fps = cut(fingerprints(rows, size, "rid", "binary"), "simhash")
    ids = rows.select("rid", F.col("doc_id").cast("long").alias("doc_id")).join(fps.dropDuplicates(["rid"]).hint("merge"), "rid")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    first = cut(ids.groupBy("fp").agg(F.min(order).alias("first")), "simhash-first")
    roots = cut(_components(fps, max_bits, most), "simhash-roots")
    kept = first.join(roots.hint("merge"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = cut(kept.select(F.col("first.rid").alias("rid")), "simhash-kept")
    release(fps, first, roots)
    return rows.join(kept.hint("merge"), "rid").dropDuplicates(["rid"]).drop("rid")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents")).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
