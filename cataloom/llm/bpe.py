"""Byte-level BPE: length-bucketed matrices of numpy, one row for each distinct piece of text.

The pattern cuts a text into pieces; each piece is encoded by itself. Pieces not met before by a worker go into padded
matrices, bucketed by length. In a round every row merges its leftmost pair of least rank, found by a hashed lookup of
(left id, right id); the row's tail moves up by one, and only the two pairs around the merge are looked up again. Rows
without a pair leave the matrix. The least rank of all pairs is taken one at a time, as the rank files mean it: a merge
may make a pair of less rank than others still waiting.

Pieces of more than `LONG` bytes (runs of letters without a space) would move long tails; there a round is the same, on a
row with links to its neighbours instead of a moved tail, in linear memory.

A worker remembers at most `REMEMBERED` pieces, then starts afresh; results don't depend on it. Nulls are empty texts: no
ids. Special tokens in a text are ordinary text. Lone surrogates can't occur in UTF-8. Rows of equal id, or of equal text,
each give a row; empty tables give empty ones; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, read, slices

LONG = 256
REMEMBERED = 300_000
NONE = np.int64(1 << 40)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left, right) -> rank of the merged token; open addressing with linear probing, all in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        at, wait = self._home(keys), np.arange(len(keys))
        self.probes = 0
        while len(wait):
            self.probes += 1
            spot = at[wait]
            free = self.keys[spot] == -1
            self.keys[spot[free]] = keys[wait[free]]  # of several for one slot the last stays
            held = self.keys[spot] == keys[wait]
            self.values[spot[held]] = values[wait[held]]
            wait = wait[~held]
            at[wait] = (at[wait] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; NONE where the pair makes no token. Ids below 0 are padding."""
        keys = (left << 32) | right
        keys = np.where((left < 0) | (right < 0), -2, keys)
        at = self._home(keys)
        out = np.full(keys.shape, NONE, np.int64)
        found = self.keys[at]
        hit = found == keys
        out[hit] = self.values[at[hit]]
        wait = np.nonzero(~hit & (found != -1))
        while len(wait[0]):
            at[wait] = (at[wait] + 1) & self.mask
            found = self.keys[at[wait]]
            hit = found == keys[wait]
            w = tuple(x[hit] for x in wait)
            out[w] = self.values[at[w]]
            wait = tuple(x[~hit & (found != -1)] for x in wait)
        return out


class Encoder:
    """A vocabulary of byte strings with ranks, which are the ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.words = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            self.words[rank] = word
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[w[:k]] << 32 | ranks[w[k:]], r) for w, r in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ()))))
        self.known: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, by rounds over padded matrices; pieces of like length share a matrix."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if piece in self.ranks:
                out[i] = self.ranks[piece].to_bytes(4, "little")
            elif len(piece) > LONG:
                out[i] = self._merge_long(piece).astype("<u4").tobytes()
            elif piece:
                buckets.setdefault((len(piece) + 3) // 4, []).append(i)
        for width, rows in buckets.items():
            for k in range(0, len(rows), 8192):
                self._merge_rows(pieces, rows[k : k + 8192], 4 * width, out)
        return out

    def _merge_rows(self, pieces: list[bytes], rows: list[int], width: int, out: list[bytes]) -> None:
        at = np.array(rows)
        sizes = np.array([len(pieces[i]) for i in rows])
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        ids = np.where(np.arange(width) < sizes[:, None], self.byte[raw], -1)
        ids = np.concatenate((ids, np.full((len(rows), 1), -1, np.int64)), axis=1)
        best = self.pairs.get(ids[:, :-1], ids[:, 1:])
        columns = np.arange(ids.shape[1])
        while len(at):
            where = best.argmin(axis=1)  # the first of equal ranks is the leftmost
            every = np.arange(len(at))
            rank = best[every, where]
            done = rank == NONE
            if done.any():
                held = ids[done]
                data, size, wide = held.astype("<u4").tobytes(), (4 * (held >= 0).sum(axis=1)).tolist(), 4 * held.shape[1]
                for k, (i, n) in enumerate(zip(at[done].tolist(), size, strict=True)):
                    out[i] = data[k * wide : k * wide + n]
                keep = ~done
                at, ids, best, where, rank = at[keep], ids[keep], best[keep], where[keep], rank[keep]
                every = np.arange(len(at))
                if not len(at):
                    break
            ids[every, where] = rank
            source = np.minimum(columns + (columns > where[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ids[:, -1] = -1
            best = np.take_along_axis(best, source[:, :-1].clip(max=best.shape[1] - 1), axis=1)
            best[:, -1] = NONE
            best[every, where] = self.pairs.get(ids[every, where], ids[every, where + 1])
            left = np.flatnonzero(where > 0)
            best[left, where[left] - 1] = self.pairs.get(ids[left, where[left] - 1], ids[left, where[left]])
            used = int((ids >= 0).sum(axis=1).max())
            if used + 1 < ids.shape[1]:  # columns that no row uses go
                ids, best, columns = ids[:, : used + 1], best[:, :used], columns[: used + 1]

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One row with links: least rank of each stretch is kept, so that a round looks at two stretches."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].copy()
        n, side = len(ids), 256
        best = np.append(self.pairs.get(ids[:-1], ids[1:]), NONE)
        best = np.concatenate((best, np.full(-n % side, NONE, np.int64)))
        least = best.reshape(-1, side).min(axis=1)
        right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), np.ones(n, bool)
        one = lambda a, b: int(self.pairs.get(ids[a : a + 1], ids[b : b + 1])[0])
        while True:
            stretch = int(least.argmin())
            if least[stretch] == NONE:
                return ids[alive]
            at = stretch * side + int(best[stretch * side : (stretch + 1) * side].argmin())
            gone = right[at]
            ids[at], alive[gone] = best[at], False
            right[at] = right[gone]
            best[gone] = NONE
            best[at] = one(at, right[at]) if right[at] < n else NONE
            if right[at] < n:
                left[right[at]] = at
            touched = {at, gone}
            if left[at] >= 0:
                best[left[at]] = one(left[at], at)
                touched.add(left[at])
            for k in {x // side for x in touched}:
                least[k] = best[k * side : (k + 1) * side].min()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cuts = [self.pattern.findall(x) for x in texts]
        known = self.known
        new = list({p for x in cuts for p in x if p not in known})
        for k in range(0, len(new), 65536):
            some = new[k : k + 65536]
            known.update(zip(some, self.merge([p.encode() for p in some]), strict=True))
        return [b"".join(map(known.__getitem__, x)) for x in cuts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """The vocabulary of a rank file; one for each worker."""
    if (path, pattern) not in _ENCODERS:
        with open(path, "rb") as lines:
            _ENCODERS[path, pattern] = Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)
    return _ENCODERS[path, pattern]


def tokenize(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and ids (array of int) if kept; a row for each row of `docs`."""
    bound_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in slices(batches, 256):
            ids = enc.encode([x or "" for x in batch.column(1).to_pylist()])
            columns = [
                batch.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids]),
            ]
            if keep_ids:
                ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), keep_ids=False)
