"""What the operators of this subpackage share: tables, word rules, and cutting of lineage in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, release, scratch, shared_folder  # noqa: F401 - for the operators

#: A word is a run of characters other than these six; bytes.split() cuts UTF-8 at exactly these.
SPACES = " \t\n\x0b\x0c\r"
BATCH_BYTES = 4 << 20
SLICE_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Python workers get batches of at most BATCH_BYTES, however long the texts are; a smaller setting of the user stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Workers are used again by later tasks: what earlier ones freed goes back to the system first."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a libc without it keeps its pages
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def quoted(name: str) -> str:
    """A column's name for `col`, whatever characters are in it."""
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, read_: tuple[str, ...]) -> DataFrame:
    """The columns that are read; all others ride along in one struct, so that no name of theirs meets an operator's own."""
    more = [quoted(c) for c in docs.columns if c not in read_]
    return docs.select(*[c for c in docs.columns if c in read_], *([F.struct(*more).alias("_more")] if more else []))


def unpacked(columns: list[str], read_: tuple[str, ...]) -> list[Column]:
    """What selects `columns` from what `packed` made of them."""
    return [F.col(c) if c in read_ else F.col("_more")[c].alias(c) for c in columns]


def row_id(*columns: str) -> Column:
    """128 bits for a row's values: two hashes with seeds of their own, so that no two rows of a corpus meet by chance."""
    part = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    nulls = F.struct(*[F.col(c).isNull() for c in columns])  # the hashes pass over nulls
    bits = F.unhex(F.concat(part(nulls, *columns), part(F.lit(1), nulls, *columns)))
    return F.coalesce(bits, F.lit(b""))  # never null, and so known to be: no join by it filters first, and all share one exchange


def crc32_of_id(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string"))
