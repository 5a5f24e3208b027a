"""Media columns: payloads kept as 8-bit images in archives, and a Spark data source that reads archive directories.

Writing: each task packs its rows' payloads as grayscale PNG (8-bit samples, lossless) into zip archives in a directory of
the shared store, a temporary name first, so that a task that runs again replaces its archives and leaves no halves.

Reading: the data source lists the archives of a directory and plans byte ranges over them; a member belongs to the range
that holds its local header's offset. A task reads the archive's central directory, then its members in the order of
their offsets, and streams them as Arrow batches of bounded size. Each member is read by itself: on an error, or if its
checksum is wrong, the file is opened anew and the member is read again from its offset, `retries` times. A member that
still fails is a row with `error` set and no payload; the others of the range are unharmed.

Stores are reached through pyarrow's file systems, by the URI of the directory, from executors and driver alike.

Nulls: a null id stays null, a null text is empty. Equal rows are members of their own, so that ties can't matter. Empty
tables make no archive. Very long texts are one member each, read whole. Columns other than doc_id and text are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import as_bytes, bound_batches, read, scratch, slices

WIDTH = 576
FILL = b"\xff"
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes, width: int = WIDTH) -> bytes:
    """With bytes 255 up to a positive multiple of `width`. UTF-8 has no byte 255, so that they can be told from text."""
    return raw + FILL * (-len(raw) % width if raw else width)


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each line begins with its filter, 0: none
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """Samples (height x width) of an 8-bit grayscale PNG with unfiltered lines; a wrong checksum is an error."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, packed, width, height = len(SIGNATURE), [], 0, 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:]


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> tuple[int, int]:
    """Payloads of (doc_id, text) into archives under the URI `folder`; (archives, members) written."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        done: list[tuple[str, int]] = []
        part, stream, archive, name, held, members = 0, None, None, "", 0, 0

        def close() -> None:
            archive.close()
            stream.close()
            store.move(f"{root}/.{name}-{task.taskAttemptId()}", f"{root}/{name}")
            done.append((name, members))

        for batch in slices(batches, 256):
            for doc, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if archive is None:
                    name, held, members, part = f"media-{task.partitionId():06d}-{part:04d}.zip", 0, 0, part + 1
                    stream = store.open_output_stream(f"{root}/.{name}-{task.taskAttemptId()}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
                media = to_png(padded(raw))
                archive.writestr(zipfile.ZipInfo(f"{members:08d}_{'' if doc is None else doc}.png"), media)
                held, members = held + len(media), members + 1
                if held >= archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([m for _, m in done], pa.int64())], names=["archive", "members"])

    written = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "archive string, members long")
    return tuple(written.agg(F.count("*"), F.coalesce(F.sum("members"), F.lit(0))).first())


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.batch = int(options.get("batchbytes", BATCH_BYTES))
        self.retries = int(options.get("retries", 3))
        self.archives = int(options.get("archives", -1))

    def partitions(self) -> list[ByteRange]:
        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".zip"))
        if self.archives >= 0 and len(files) != self.archives:
            raise OSError(f"{len(files)} archives in {self.folder}, and {self.archives} were written")
        ranges = [ByteRange(p, a, min(a + self.split, n)) for p, n in files for a in range(0, n, self.split)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        rows: list[tuple] = []
        size = 0
        for offset, name, n, crc in self.members(store, partition):
            media, error = self.member(store, partition.path, offset, n, crc)
            rows.append((partition.path, name, offset, media, error))
            size += n
            if size >= self.batch or len(rows) >= 1024:
                yield self.rows(rows)
                rows, size = [], 0
        if rows:
            yield self.rows(rows)
        self.close()

    def members(self, store: fs.FileSystem, partition: ByteRange) -> list[tuple[int, str, int, int]]:
        """(offset, name, size, checksum) of the range's members, by the archive's directory; read again where that fails."""
        for turn in range(self.retries + 1):
            try:
                with store.open_input_file(partition.path) as file:
                    found = zipfile.ZipFile(file).infolist()
                return sorted((i.header_offset, i.filename, i.file_size, i.CRC) for i in found if partition.start <= i.header_offset < partition.end)
            except (OSError, zipfile.BadZipFile):
                if turn == self.retries:
                    raise
        return []

    _open: tuple[str, object] | None = None

    def close(self) -> None:
        if self._open:
            self._open[1].close()
            self._open = None

    def member(self, store: fs.FileSystem, path: str, offset: int, n: int, crc: int) -> tuple[bytes | None, str | None]:
        """One stored member by its offset: (payload, None), or (None, what went wrong) once retries are used up."""
        wrong = ""
        for turn in range(self.retries + 1):
            try:
                if self._open is None:
                    self._open = (path, store.open_input_file(path))
                file = self._open[1]
                file.seek(offset)
                head = file.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise OSError("no member at this offset")
                name, extra = struct.unpack_from("<HH", head, 26)
                file.seek(offset + 30 + name + extra)
                data = file.read(n)
                if len(data) != n or zlib.crc32(data) != crc:
                    raise OSError("payload is damaged")
                return data, None
            except (OSError, pa.ArrowException, struct.error) as e:
                wrong = str(e)
                self.close()
                time.sleep(0.05 * 2**turn * (turn < self.retries))
        return None, wrong

    @staticmethod
    def rows(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["archive", "member", "offset", "media", "error"])


class ArchiveMedia(DataSource):
    """spark.read.format("archive_media").load(directory URI); options splitBytes, batchBytes and retries."""

    @classmethod
    def name(cls) -> str:
        return "archive_media"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in dict(self.options).items()})


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveMedia)
    return spark.read.format("archive_media").options(**options).load(folder)


def feature_of(samples: np.ndarray) -> str:
    """Height, mean, variance and entropy of an image's samples."""
    seen = np.bincount(samples.ravel(), minlength=256)
    n, value = int(seen.sum()), np.arange(256)
    mean = int((seen * value).sum()) / n
    var = int((seen * value * value).sum()) / n - mean * mean
    p = seen[seen > 0] / n
    return f"h={len(samples)};mean={mean:.4f};var={var:.3f};entropy={-(p * np.log2(p)).sum():.5f}"


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Of rows that read_archives gives: each payload decoded, and what is read off it. A member with an error is an error here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in slices(batches, 256):
            out = []
            for archive, member, data, error in zip(*(batch.column(k).to_pylist() for k in ("archive", "member", "media", "error")), strict=True):
                if error:
                    raise OSError(f"{archive}, {member}: {error}")
                samples = from_png(data)
                payload = samples.tobytes()
                doc = member.rpartition(".")[0].partition("_")[2]
                out.append((int(doc) if doc else None, len(payload.rstrip(FILL)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(samples)))
            columns = zip(*out, strict=True) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return media.mapInArrow(run, FEATURES)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "media")
    archives, _ = write_archives(read(spark, sf_dir, "documents"), folder)
    return features(read_archives(spark, folder, archives=str(archives)))
