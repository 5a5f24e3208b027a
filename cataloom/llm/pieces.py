"""SentencePiece encoding of the merge type, exact, by backtracking instead of by merging whole texts.

A list of tokens is what merging gives if and only if each token comes of merging its own characters, and each two neighbours
come of merging theirs: the first merge across a border of such a list would be made for the two neighbours alone, too. So
tokens are laid from left to right. At each place the longest token that starts there comes first, found for all places by
one pass of an Aho-Corasick automaton (of reversed tokens, over the reversed text); where it doesn't fit its neighbour, the next
shorter one. Whether two tokens fit is asked by merging the characters of both, and remembered. A place from which no
token fits is marked in a bitfield and not tried again: what leads to a place is the same on every way, as merging gives one
result. Merges go by score, the leftmost of equal ones first.

Where no token has a sign other than the word mark before a word mark, nothing is ever merged across such a border: texts
are encoded by the words between, and words met before are remembered by a worker, twice `REMEMBERED` at most, those met last;
results don't depend on it. Characters of no token are written as bytes.

Nulls and empty texts have no ids. Very long texts and words are encoded in time that grows with them. Rows of equal id,
or of equal text, each give a row; ties of scores are broken by place; empty tables give empty ones; columns other
than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, read, slices

MARK = "▁"
REMEMBERED = 300_000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2  # the model type whose pieces are merges


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Fits(dict):
    """What is known of tokens after one: their ids and what may follow, or None for those that don't fit."""

    def __init__(self, token: str):
        super().__init__()
        self.token = token


class Pieces:
    """A vocabulary of pieces with scores, read from a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        kind, fallback, rules = 1, 0, {3: 1, 4: 1, 5: 1}
        for field, value in _fields(data):
            if field == 1:
                x = dict(_fields(value))
                self.pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif field == 2:
                trained = dict(_fields(value))
                kind, fallback = trained.get(3, 1), trained.get(35, 0)
            elif field == 3:
                rules |= dict(_fields(value))
        if kind != MERGES or not fallback or rules.get(2) or rules[4] or not rules[5] or {t for *_, t in self.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only models of merges with bytes for unknown characters, texts as they are, and no pieces of the user's own are known")
        self.prefix = MARK if rules[3] else ""
        self.id = {p: k for k, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        self.score = {p: s for p, s, t in self.pieces if t == NORMAL}
        self.byte = {int(p[1:-1], 16): k for k, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.value = {k: b for b, k in self.byte.items()}
        characters = sorted({c for p in self.id for c in p})
        every = [*self.id, *(c for c in characters if c not in self.id)]  # each character is a token, with an id or not
        self.ends = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in every:
            self.ends.add_word(p[::-1], len(p))
        self.ends.make_automaton()
        tokens = set(every)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in tokens), None) for p in every}
        one_word = any(a != MARK and b == MARK for p in self.id for a, b in zip(p, p[1:], strict=False))
        self.words = re.compile(".+" if one_word else f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        self.between = next(c for c in map(chr, range(0x10000)) if c not in set(characters))  # no token holds it
        # a byte beyond ASCII is a lone surrogate, which encodes to that byte
        self.texts = [bytes([self.value[k]]).decode("ascii", "surrogateescape") if t == BYTE else " ⁇ " if t == UNKNOWN else p.replace(MARK, " ") if t == NORMAL else "" for k, (p, _, t) in enumerate(self.pieces)]
        self.controls = {k for k, (*_, t) in enumerate(self.pieces) if t == CONTROL}
        self.decimal = list(map(str, range(len(self.pieces))))
        self.first = Fits("")
        self.fits, self.pairs = {"": self.first}, 0
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """The characters of a short text, merged: the pair of best score first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            at, best = -1, -np.inf
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1], -np.inf)
                if score > best:
                    at, best = k, score
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, after: Fits, token: str) -> tuple[tuple[int, ...], Fits] | None:
        """The ids of a token and what is known of tokens after it; None if it doesn't fit, when merging gives something else than both."""
        if self.pairs > REMEMBERED:  # later words begin anew; a word in work goes on with what it holds
            self.first = Fits("")
            self.fits, self.pairs = {"": self.first}, 0
        self.pairs += 1
        found = None
        if self.merged(after.token + token) == [x for x in (after.token, token) if x]:
            ids = (self.id[token],) if token in self.id else tuple(self.byte[b] for b in token.encode())
            found = ids, self.fits.setdefault(token, Fits(token))
        after[token] = found
        return found

    def longest(self, text: str) -> list[int]:
        """Of each place of a text the length of the longest token that starts there; 1 for a character of no token."""
        size = len(text)
        out = np.ones(size, np.int64)
        found = np.fromiter(itertools.chain.from_iterable(self.ends.iter(text[::-1])), np.int64).reshape(-1, 2)
        if len(found):
            end, length = found.T
            first = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
            out[size - 1 - end[first]] = np.maximum.reduceat(length, first)
        return out.tolist()

    def tokens(self, text: str, longest: list[int], start: int = 0) -> list[tuple[str, tuple[int, ...]]]:
        """(token, ids) of a text, which is at `start` of the one that `longest` was asked for. A character of no token is one by itself."""
        size, shorter = len(text), self.shorter
        failed = None  # a bitfield, once something has failed
        out: list[tuple[str, tuple[int, ...]]] = []
        way: list[Fits] = []
        at, after = 0, self.first
        token = text[: longest[start]] if size else ""
        while at < size:
            end = at + len(token)
            if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                found = after.get(token, False)
                if found is False:
                    found = self._fit(after, token)
                if found is not None:  # that both stay as they are says that each does
                    ids, following = found
                    out.append((token, ids))
                    way.append(after)
                    at, after = end, following
                    if at < size:
                        token = text[at : at + longest[start + at]]
                    continue
            token = shorter.get(token)
            while token is None:  # nothing fits here: the token that led here was wrong
                if failed is None:
                    failed = bytearray(size // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                wrong, _ = out.pop()
                at, after = at - len(wrong), way.pop()
                token = shorter.get(wrong)
        return out

    def _learn(self, words: list[str]) -> None:
        """Ids of words not met before, all asked of the automaton at once."""
        longest = self.longest(self.between.join(words))
        start = 0
        for word in words:
            self.known[word] = tuple([k for _, ids in self.tokens(word, longest, start) for k in ids])
            start += len(word) + 1

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        cuts = [self.words.findall(self.prefix + text.replace(" ", MARK)) if text else [] for text in texts]
        new = {w for words in cuts for w in words if w not in self.known}
        again = {w: self.older[w] for w in new if w in self.older}
        self.known |= again
        self._learn([w for w in new if w not in again])
        known = self.known
        out = [list(itertools.chain.from_iterable(map(known.__getitem__, words))) for words in cuts]
        for w in new:  # long ones aren't kept
            if len(w) > 100:
                del known[w]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text: marks are spaces, and the one that every text begins with goes; bytes that are no UTF-8 are replaced one by one."""
        out: list[str] = []
        runs = [ids] if self.controls.isdisjoint(ids) else [list(x) for _, x in itertools.groupby(ids, self.controls.__contains__)]  # no character goes across one
        for run in runs:
            raw = "".join(map(self.texts.__getitem__, run)).encode("utf-8", "surrogateescape")
            while raw:
                try:
                    out.append(raw.decode())
                    raw = b""
                except UnicodeDecodeError as bad:
                    out.append(raw[: bad.start].decode() + "�")
                    raw = raw[bad.start + 1 :]
        text = "".join(out)
        return text[1:] if self.prefix and text[:1] == " " and ids and self._begins_marked(ids) else text

    def _begins_marked(self, ids: list[int]) -> bool:
        """Whether the first text of a list is a piece's that begins with a mark."""
        first = next((self.pieces[k] for k in ids if self.texts[k]), ("", 0.0, NORMAL))
        return first[2] == NORMAL and first[0][:1] == MARK


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """The vocabulary of a model file; one for each worker."""
    if path not in _MODELS:
        with open(path, "rb") as file:
            _MODELS[path] = Pieces(file.read())
    return _MODELS[path]


def encode_pieces(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and ids (array of int) if kept; a row for each row of `docs`."""
    bound_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in slices(batches, 256):
            ids = pieces.encode_all([x or "" for x in batch.column(1).to_pylist()])
            columns = [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(",".join(map(pieces.decimal.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(pieces.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


VOCABULARY = "piece_bpe_32k.model"


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), keep_ids=False)
