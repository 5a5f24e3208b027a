"""Landed batches of pages as a streaming source: a file for each batch, its number the offset, read by tasks in bounded Arrow batches.

A crawl lands `<number>.jsonl` in a folder that driver and executors share, a file or a folder of files, a page on each line: url,
content_type, and the bytes as they came, in base64. A stream reads each batch once: offsets are numbers, a batch never changes,
and one that a stop cut short is read again from its start. A task reads a range of a file of at most RANGE_BYTES, and the rest
of the line that it ends in. Files that aren't named by a number are none of the source's. A line
without an address or without content is a page that has none; broken lines fail the task, as landed files are our own.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructType

from ..functions import text, urls
from ..schema import SCRAPED, conform
from . import landed

PAGES = "landing long, url string, content_type string, content binary"
_PAGES = pa.schema([("landing", pa.int64()), ("url", pa.string()), ("content_type", pa.string()), ("content", pa.binary())])
SUFFIX = ".jsonl"
BATCH_BYTES = 4 << 20
#: A task's share of a landed file.
RANGE_BYTES = 64 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://", 1))


class Batch(InputPartition):
    """Lines of a file that begin at `start` or later, and before `end`."""

    def __init__(self, path: str, number: int, start: int, end: int):
        self.path, self.number, self.start, self.end = path, number, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def _numbers(self) -> list[int]:
        files, folder = _opened(self.folder)
        names = (f.base_name for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)))
        return sorted(int(n.removesuffix(SUFFIX)) for n in names if n.endswith(SUFFIX) and n.removesuffix(SUFFIX).isdigit())

    def _ranges(self, number: int) -> Iterator[Batch]:
        uri = f"{self.folder.rstrip('/')}/{number}{SUFFIX}"
        files, path = _opened(uri)
        found = files.get_file_info(path)
        inside = [found] if found.is_file else [f for f in files.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name[0] not in "._"]
        for f in sorted(inside, key=lambda f: f.base_name):
            for start in range(0, f.size, RANGE_BYTES):
                yield Batch(uri if found.is_file else f"{uri}/{f.base_name}", number, start, min(start + RANGE_BYTES, f.size))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"batch": max(self._numbers(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Batch]:
        return [b for n in self._numbers() if start["batch"] < n <= end["batch"] for b in self._ranges(n)]

    def commit(self, end: dict) -> None:
        """Batches stay where they landed."""

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        files, path = _opened(partition.path)
        rows: list[tuple] = []
        held = 0
        # a line that begins before the range is another task's: from the last byte before it, all to the first line end is left out
        at = max(partition.start - 1, 0)
        skip = partition.start > 0
        with files.open_input_file(path) as lines:
            lines.seek(at)
            rest = b""
            while at < partition.end:
                chunk = lines.read(1 << 20)
                *whole, rest = (rest + chunk).split(b"\n") if chunk else (*((rest,) if rest else ()), b"")
                for line in whole:
                    begins, at = at, at + len(line) + 1
                    if skip or begins >= partition.end:
                        skip = False
                        continue
                    if line.strip():
                        page = json.loads(line)
                        content = base64.b64decode(page["content"]) if page.get("content") is not None else None
                        rows.append((partition.number, page.get("url"), page.get("content_type"), content))
                        held += len(line)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAGES, strict=True)], schema=_PAGES)
                        rows, held = [], 0
                if not chunk:
                    break
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAGES, strict=True)], schema=_PAGES)


class LandedPages(DataSource):
    """spark.readStream.format("landed_pages").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return PAGES

    def streamReader(self, schema: StructType) -> _Reader:  # noqa: N802
        return _Reader(self.options["path"])


def land(lines: DataFrame, folder: str) -> None:
    """Writes batches of lines (batch, line) as `<number>.jsonl`: each task writes its lines of every batch, and a batch's folder is then named.

    All batches are written in one pass. A batch is there as a whole, with its name; one that is landed again takes its place.
    """
    spark, folder = lines.sparkSession, folder.rstrip("/")
    part = f"{folder}/_landing"
    lines.where("batch is not null").write.mode("overwrite").partitionBy("batch").text(part)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for written in files.globStatus(path(f"{part}/batch=*")):  # a batch is a crawl: there are few
        named = path(f"{folder}/{written.getPath().getName().removeprefix('batch=')}{SUFFIX}")
        files.delete(named, True)
        if not files.rename(written.getPath(), named):
            raise OSError(f"{named} could not be named")
    files.delete(path(part), True)


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """(landing, url, content_type, content) of the batches that land in a folder."""
    spark.dataSource.register(LandedPages)
    return spark.readStream.format("landed_pages").load(folder)


@F.arrow_udf(StringType())
def page_text(content: pa.Array, content_type: pa.Array) -> pa.Array:
    """Pages as text: by the charset that their header names, else by that of their head, else as UTF-8; bytes that don't fit are replaced."""
    return pa.array([landed.text_of(raw, kind) for raw, kind in zip(content.to_pylist(), content_type.to_pylist(), strict=True)], pa.string())


def newest_pages(pages: DataFrame) -> DataFrame:
    """Of pages (landing, url, ...) that landed several times, by address without its frills, the row of the last batch."""
    key = urls.page_key(F.col("url"))
    columns = pages.columns
    last = pages.where("url is not null").groupBy(key.alias("page")).agg(F.max_by(F.struct(*columns), F.struct("landing", "url")).alias("p"))
    return last.select("page", *[F.col(f"p.{c}").alias(c) for c in columns])


def shop_items(json_text: Column, pages: DataFrame, source: Column, event_type: str = "発売") -> DataFrame:
    """Scraped items of a shop's product pages: one for each product and source, of the last batch it was in.

    A product's address is that of its shop and handle; its price is the first variant's in yen, and its first picture its image.
    The day the shop listed it is kept as that, never as the day of an event. Products without a handle or a title are no items.
    """
    product = F.explode(landed.products(json_text)).alias("p")
    rows = pages.select(F.col("landing"), source.alias("source"), F.concat(F.lit("https://"), urls.host(F.col("url"))).alias("shop"), product)
    rows = rows.where("length(p.handle) > 0 and length(trim(p.title)) > 0")
    one = rows.groupBy("source", F.col("p.handle").alias("handle")).agg(F.max_by(F.struct("shop", "p"), F.struct("landing", F.col("p.id"))).alias("x"))
    yen = F.floor(F.col("x.p.price").try_cast("double")).cast("long")
    made = one.select(
        "source",
        F.col("handle").alias("source_id"),
        text.clean_title(F.col("x.p.title")).alias("title"),
        text.classify_genre(F.col("x.p.title")).alias("genre"),
        F.lit(event_type).alias("event_type"),
        F.concat("x.shop", F.lit("/products/"), "handle").alias("url"),
        F.when(yen > 0, F.concat(F.format_number(yen, 0), F.lit("円"))).alias("price"),
        F.col("x.p.image").alias("image_url"),
        F.try_to_timestamp(F.col("x.p.published_at")).alias("store_listed_at"),
    )
    return conform(made, SCRAPED)
