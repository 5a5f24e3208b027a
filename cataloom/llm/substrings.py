"""Removal of repeated passages by fixed-block anchors.

A window is `window` consecutive words of one document; every word covered by a window whose word sequence also starts
earlier (smaller id, or the same document and an earlier start) goes. Two rounds find these windows:

1. Anchors. Blocks of `(window + 1) // 2` words at fixed, non-overlapping places of each document are the index; every
   rolling window of that many words, of all documents, probes it. Any window holds at least one of its own document's
   blocks, and if its sequence occurs again, each of its blocks is met by a probe from there. Probes and blocks meet in
   buckets of their hashes; a probe is four bytes, delta-coded, so that all of them fit a fraction of the input. What
   comes back are the blocks that occur elsewhere. Hash collisions add candidates here and lose none.
2. Extension, by hashes and not word by word: the windows all of whose blocks were hit are compared with each other by
   96-bit hashes of the whole window, not by their words; all but the first of each sequence are repeats. Runs of repeats
   that overlap or touch are one maximal span, and the words of the spans go.

Each task first settles what it can by itself: of equal probes or windows in one unit (the documents of a task, up to
`UNIT_WORDS` words) one is sent. A passage that a third of all documents share so sends one entry a unit, and no pair of
documents is ever made. Results return to the unit, whose directory turns them into rows of documents.

A worker settles one bucket at a time. There are as many buckets as the texts' bytes ask for, about `BUCKET_WORDS` words
each, and as many partitions, so that a worker's memory doesn't grow with the corpus. A unit sends a row to each bucket it
has entries for: at most one a probe, however many buckets there are.

Nulls: a null text has no words; null ids sort before all others. A row's identity is a hash of 128 bits of id and text, so
rows with equal ids and texts are one document and get equal results, rows with equal ids and other texts are told apart.
Ties: equal windows of one id and one start, in rows of other texts, are all first. Empty tables give empty results. Extra
columns stay, whatever their names; one named dedup is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, give_back, packed, read, row_id, slices, unpacked

WINDOW = 20
UNIT_WORDS = 1 << 20
#: Words, and so probes at most, that fall into a bucket on average.
BUCKET_WORDS = 1 << 23
WORD_BYTES = 6
REMEMBERED = 300_000
ROWS = "bucket int, unit long, kind int, data binary"
WORD = re.compile(rb"[^ \t-\r]+")
#: Where null ids stand in the order of ids.
NULL_ID = -(1 << 63)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolling(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, power = np.zeros(n, np.uint64), 1
    for k in range(size):
        out += hashes[k : k + n] * np.uint64(power)
        power = power * base % (1 << 64)
    return mixed(out)


def pack(values: np.ndarray, ordered: bool) -> bytes:
    """Unsigned 32-bit values by byte planes, ordered ones as differences: high planes are runs that compress away."""
    x = np.diff(values, prepend=values.dtype.type(0)) if ordered else values
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(data: bytes, ordered: bool) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(x) if ordered else x


def joined(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def parted(data: bytes, n: int) -> list[bytes]:
    ends = 4 * n + np.cumsum([0, *np.frombuffer(data[: 4 * n], "<u4").tolist()])
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


DIRECTORY, RESULT, ENTRIES = 0, 1, 2


class Unit:
    """Documents of a task, gathered until there are enough words; `rows` makes the unit's rows of ROWS."""

    def __init__(self) -> None:
        self.rids: list[bytes] = []
        self.ids: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.hits: list[np.ndarray] = []
        self.words = 0

    def add(self, rid: bytes, doc: int, hashes: np.ndarray, hits: np.ndarray | None = None) -> None:
        self.rids.append(rid)
        self.ids.append(doc)
        self.hashes.append(hashes)
        if hits is not None:
            self.hits.append(hits)
        self.words += len(hashes)

    def places(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row in the joined hashes, document, start) of each window of `size` words that lies in one document."""
        sizes = np.array([len(x) for x in self.hashes], np.int64)
        n = np.maximum(sizes - size + 1, 0)
        base = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(n)), n)
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return base[doc] + start, doc, start

    def directory(self, buckets: int) -> tuple[int, list[tuple]]:
        rids = b"".join(self.rids)
        unit = xxhash.xxh64_intdigest(rids) >> 1
        return unit, [(unit % buckets, unit, DIRECTORY, rids)]


def result(doc: np.ndarray, start: np.ndarray) -> bytes:
    order = np.lexsort((start, doc))
    return joined(pack(doc[order].astype(np.int64), True), pack(start[order].astype(np.int64), False))


def anchors(unit: Unit, buckets: int, block: int) -> list[tuple]:
    """Round 1 of a unit: per bucket, probes that need no answer and blocks that do; blocks met in the unit are results."""
    number, rows = unit.directory(buckets)
    at, doc, start = unit.places(block)
    if not len(at):
        return rows
    keys = rolling(np.concatenate(unit.hashes), block, _BASES[0])[at]
    order = np.argsort(keys, kind="stable")
    keys, doc, start = keys[order], doc[order], start[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(keys)))
    aligned = start % block == 0
    local = aligned & np.repeat(sizes > 1, sizes)
    if local.any():
        rows.append((number % buckets, number, RESULT, result(doc[local], start[local])))
    asks = aligned[first] & (sizes == 1)
    key, doc, start = keys[first], doc[first], start[first]
    bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    short = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.lexsort((short, asks, bucket))
    bucket, short, asks, doc, start = bucket[order], short[order], asks[order], doc[order], start[order]
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(ends)):
        a, b = ends[k], ends[k + 1]
        m = a + int(np.searchsorted(asks[a:b], True))
        rows.append((int(k), number, ENTRIES, joined(pack(short[a:m], True), pack(short[m:b], True), pack(doc[m:b], False), pack(start[m:b], False))))
    return rows


def met(entries: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Round 1 of a bucket: (unit, result) for blocks whose hash another unit has too."""
    probes, asks, units, docs, starts = [], [], [], [], []
    for unit, data in entries:
        p, a, d, s = parted(data, 4)
        probes.append(unpack(p, True))
        asks.append(unpack(a, True))
        docs.append(unpack(d, False))
        starts.append(unpack(s, False))
        units.append(np.full(len(asks[-1]), len(units)))
    asked = np.concatenate(asks)
    every = np.sort(np.concatenate((*probes, asked)))
    twice = np.searchsorted(every, asked, "right") - np.searchsorted(every, asked, "left") > 1
    unit, doc, start = np.concatenate(units)[twice], np.concatenate(docs)[twice], np.concatenate(starts)[twice]
    for k in np.unique(unit):
        yield entries[k][0], result(doc[unit == k], start[unit == k])


def windows(unit: Unit, buckets: int, window: int, block: int) -> list[tuple]:
    """Round 2 of a unit: candidate windows, the first of each sequence; later ones in the unit are results."""
    number, rows = unit.directory(buckets)
    at, doc, start = unit.places(window)
    if not len(at):
        return rows
    flat = np.concatenate(unit.hashes)
    sizes = np.array([len(x) for x in unit.hashes], np.int64)
    base = np.cumsum(sizes) - sizes
    hit = np.zeros(len(flat) + block, bool)
    hit[np.concatenate([b + h for b, h in zip(base, unit.hits, strict=True)])] = True
    one = -(-start // block) * block - start  # to the first block of the document within the window
    fine = hit[at + one] & ((one + block > window - block) | hit[at + np.minimum(one + block, window - block)])
    at, doc, start = at[fine], doc[fine], start[fine]
    if not len(at):
        return rows
    k1, k2 = rolling(flat, window, _BASES[0])[at], rolling(flat, window, _BASES[1])[at]
    ids = np.array(unit.ids, np.int64)
    order = np.lexsort((start, ids[doc], k2, k1))
    k1, k2, doc, start = k1[order], k2[order], doc[order], start[order]
    first = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = (ids[doc] != ids[doc[head]]) | (start != start[head])
    if later.any():
        rows.append((number % buckets, number, RESULT, result(doc[later], start[later])))
    k1, k2, doc, start = k1[~later], k2[~later], doc[~later], start[~later]
    bucket = ((k2 >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((start, doc, bucket))
    k1, k2, doc, start, bucket = k1[order], k2[order], doc[order], start[order], bucket[order]
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(ends)):
        part = slice(ends[k], ends[k + 1])
        some = np.unique(doc[part])
        short = (k2[part] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rows.append((int(k), number, ENTRIES, joined(k1[part].astype("<u8").tobytes(), pack(short, False), pack(doc[part], True), pack(start[part], False), pack(some, True), ids[some].astype("<i8").tobytes())))
    return rows


def repeated(entries: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Round 2 of a bucket: (unit, result) for windows that are not the first of their sequence."""
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    for number, (_, data) in enumerate(entries):
        a, b, d, s, some, ids = parted(data, 6)
        doc = unpack(d, True)
        of = np.frombuffer(ids, "<i8")[np.searchsorted(unpack(some, True), doc)]
        for column, x in zip(columns, (np.frombuffer(a, "<u8"), unpack(b, False), of, unpack(s, False), doc, np.full(len(doc), number)), strict=True):
            column.append(x)
    k1, k2, of, start, doc, unit = (np.concatenate(x) for x in columns)
    order = np.lexsort((start, of, k2, k1))
    k1, k2, of, start, doc, unit = (x[order] for x in (k1, k2, of, start, doc, unit))
    first = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = (of != of[head]) | (start != start[head])
    unit, doc, start = unit[later], doc[later], start[later]
    for k in np.unique(unit):
        yield entries[k][0], result(doc[unit == k], start[unit == k])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "unit", "kind", "data"])


def _meet(rows: DataFrame, buckets: int, settle) -> DataFrame:
    """(_rid, _places): rows of ROWS by bucket, settled there, back by unit; places are starts of 4 bytes each."""

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        bucket, entries = None, []
        for batch in batches:
            out: list[tuple] = []
            for b, unit, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if entries:
                        out += [(0, u, RESULT, r) for u, r in settle(entries)]
                    bucket, entries = b, []
                if kind == ENTRIES:
                    entries.append((unit, data))
                else:
                    out.append((0, unit, kind, data))
            yield _rows(out)
        yield _rows([(0, u, RESULT, r) for u, r in settle(entries)] if entries else [])

    def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        unit, rids, docs, starts = None, b"", [], []

        def close() -> pa.RecordBatch:
            doc, start = np.concatenate([np.empty(0, np.int64), *docs]), np.concatenate([np.empty(0, np.int64), *starts])
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order].astype("<u4")
            which, first = np.unique(doc, return_index=True)
            ends = np.append(first, len(doc))
            places = [start[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array([rids[16 * k : 16 * k + 16] for k in which.tolist()], pa.binary()), pa.array(places, pa.binary())], names=["_rid", "_places"])

        for batch in batches:
            for _, u, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != unit:
                    if unit is not None:
                        yield close()
                    unit, rids, docs, starts = u, b"", [], []
                if kind == DIRECTORY:
                    rids = data
                else:
                    d, s = parted(data, 2)
                    docs.append(unpack(d, True))
                    starts.append(unpack(s, False))
        if unit is not None:
            yield close()

    back = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "unit").mapInArrow(by_bucket, ROWS)
    return back.repartition(buckets, "unit").sortWithinPartitions("unit", "kind").mapInArrow(by_unit, "_rid binary, _places binary")


def _distinct(places: DataFrame) -> DataFrame:
    """One row for each _rid: rows of equal id and text may lie in several units, each with its own part of the answer."""
    joined_ = F.expr("aggregate(all, cast('' as binary), (a, b) -> concat(a, b))")
    return places.groupBy("_rid").agg(F.collect_set("_places").alias("all")).select("_rid", joined_.alias("_places"))


def buckets_for(docs: DataFrame) -> int:
    """By the bytes of all texts; never fewer than the session's partitions."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (WORD_BYTES * BUCKET_WORDS)))


def repeats(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(_rid, places) of documents with repeats: starts of the windows whose words go. `docs` has _rid, doc_id and text.

    Extra columns of `docs` go along into the workers, so that its exchange by _rid is the same one, and read again, in a
    join that keeps them.
    """
    block = (window + 1) // 2

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, unit = WordHashes(), Unit()
        for batch in slices(batches, 128):
            for rid, raw in zip(batch.column("_rid").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if len(found := raw.split()) >= window:
                    unit.add(rid, 0, words.of(found))
            if unit.words >= UNIT_WORDS:
                yield _rows(anchors(unit, buckets, block))
                unit = Unit()
        if unit.words:
            yield _rows(anchors(unit, buckets, block))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, unit = WordHashes(), Unit()
        for batch in slices(batches, 128):
            rids, places = batch.column("_rid").to_pylist(), batch.column("_places").to_pylist()
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for rid, doc, raw, hits in zip(rids, ids, as_bytes(batch.column("text")), places, strict=True):
                unit.add(rid, NULL_ID if doc is None else doc, words.of(raw.split()), np.frombuffer(hits, "<u4").astype(np.int64))
            if unit.words >= UNIT_WORDS:
                yield _rows(windows(unit, buckets, window, block))
                unit = Unit()
        if unit.words:
            yield _rows(windows(unit, buckets, window, block))

    hits = _distinct(_meet(docs.mapInArrow(first, ROWS), buckets, met))
    near = docs.join(hits, "_rid")
    return _distinct(_meet(near.mapInArrow(second, ROWS), buckets, repeated))


def spans_of(places: bytes | None, window: int) -> list[tuple[int, int]]:
    """Maximal runs of words (first, end) that repeated windows cover."""
    if not places:
        return []
    start = np.unique(np.frombuffer(places, "<u4").astype(np.int64))
    new = np.concatenate(([True], start[1:] > start[:-1] + window))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return list(zip(start[new].tolist(), (start[last] + window).tolist(), strict=True))


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    """The words outside of spans, joined by one space."""
    ends = [0, *[b for _, b in spans]]
    return b" ".join(w for a, b in zip(ends, [*[a for a, _ in spans], len(words)], strict=True) for w in words[a:b])


def kept_text(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its spans: each goes with the white space up to the next word; all other white space stays."""
    if not spans:
        return raw
    at = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
    ends = [0, *[at[b] for _, b in spans]]
    return b"".join(raw[a:b] for a, b in zip(ends, [*[at[a] for a, _ in spans], len(raw)], strict=True))


KEPT = "n_words long, n_removed long, kept string, spans array<struct<first: long, end: long>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _kept_udf(window: int, keep: str):
    def kept_of(raw: bytes, words: list[bytes], spans: list[tuple[int, int]]) -> str:
        if keep == "text":
            return kept_text(raw, spans).decode()
        kept = kept_words(words, spans)
        return hashlib.sha256(kept).hexdigest() if keep == "sha256" else kept.decode()

    @F.arrow_udf(KEPT)
    def kept(text: pa.Array, places: pa.Array) -> pa.Array:
        columns: tuple[list, ...] = ([], [], [], [])
        for raw, p in zip(as_bytes(text), places.to_pylist(), strict=True):
            words, spans = raw.split(), spans_of(p, window)
            row = (len(words), sum(b - a for a, b in spans), kept_of(raw, words, spans), [{"first": a, "end": b} for a, b in spans])
            for column, x in zip(columns, row, strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.string(), _SPANS)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["n_words", "n_removed", "kept", "spans"])

    return kept


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep: str = "words") -> DataFrame:
    """`docs` with dedup: a struct of n_words, n_removed, kept, and spans (first word and end of each maximal repeat).

    kept: the words left, joined by one space ("words"), the SHA-256 of those ("sha256"), or the text with its spans cut out
    and all else as it was ("text"). One plan: the exchange of the texts by _rid is written once and read by both joins.
    """
    bound_batches(docs.sparkSession)
    docs, own = docs.drop("dedup"), ("doc_id", "text")
    rows = packed(docs, own).withColumn("_rid", row_id(*own))
    found = repeats(rows, window, buckets_for(docs))
    dedup = _kept_udf(window, keep)("text", F.col("_places"))
    return rows.join(found, "_rid", "left").select(*unpacked(docs.columns, own), dedup.alias("dedup"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs, keep="sha256").select("doc_id", "dedup.n_words", "dedup.n_removed", F.col("dedup.kept").alias("kept_sha256"))
