"""Sharding by extendible hashing, in DataFrame operations only.

A directory maps prefixes of a 60-bit hash to shards. It starts with the empty prefix; a bucket over the byte limit
splits on the next bit, and only such a bucket does, so that shards keep prefixes of different lengths.

The directory is not built document by document: one aggregation sums bytes for each prefix of `step` bits (partial sums
before the shuffle), the sums of all shorter prefixes follow from these few rows, and a bucket's depth is the first at
which its sum fits. Only the documents of cells still too large at the deepest bit go into the next round, with `step`
more bits. Documents with the same hash (repeated ids) can't be told apart by bits: they are dealt in rounds of rows by
running byte sums, after a salted aggregation, so that these shards fit too. One document larger than the limit is a
shard by itself.

Nulls: a null id hashes as an empty string, a null text weighs nothing. Repeated rows are rows of their own. Empty tables give empty results. Extra columns
stay as they are; columns named shard, depth or shard_bytes are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

#: Production shard size: raw text bytes.
LIMIT_BYTES = 64 << 20
BITS = 60
STEP = 12


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key's text, as text of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 2), BITS, "0")


#: Most prefixes (of under 100 bytes) whose sums are broadcast.
BROADCAST_PREFIXES = 500_000


def directory(sized: DataFrame, limit: int, start: int, step: int) -> DataFrame:
    """Of rows (bits, n_bytes) whose buckets at `start` bits are all over the limit: leaf prefixes as (cell, depth, shard_bytes, over).

    `cell` is a prefix of start + step bits, `depth` the bits that its leaf has; over: still too large at the last bit.
    Sums of prefixes are counted: all but the largest directories are broadcast to the cells, so that the cells below a short
    prefix don't meet in one task.
    """
    end = min(BITS, start + step)
    cells = cut(sized.groupBy(F.substring("bits", 1, end).alias("cell")).agg(F.sum("n_bytes").alias("bytes")), "shard-cells")
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr("substring(cell, 1, depth)"))
    sums = cut(levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("held")), "shard-sums")
    held = F.broadcast(sums) if sums.count() <= BROADCAST_PREFIXES else sums
    fit = F.min(F.when(F.col("held") <= limit, F.struct("depth", "held"))).alias("fit")
    fits = levels.join(held, ["depth", "prefix"]).groupBy("cell").agg(fit)
    return fits.select("cell", F.coalesce("fit.depth", F.lit(end)).alias("depth"), F.col("fit.held").alias("shard_bytes"), F.col("fit").isNull().alias("over"))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES, step: int = STEP, salt: int = 64) -> DataFrame:
    """The documents' keys with (n_bytes, shard, depth, shard_bytes), one row for each row of `docs`.

    shard: the leaf's prefix in 0 and 1, "-k" appended for the k-th part of a bucket of one hash.
    """
    size = F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))
    left = cut(docs.select(F.col(key), size.alias("n_bytes"), hash_bits(F.col(key)).alias("bits")), "shard-sizes")
    done, start = [], 0
    while True:
        end = min(BITS, start + step)
        leaves = cut(directory(left, limit, start, step), "shard-directory")
        placed = left.join(leaves, F.substring(left["bits"], 1, end) == leaves["cell"]).drop("cell")
        done.append(placed.where(~F.col("over")).select(key, "n_bytes", F.expr("substring(bits, 1, depth)").alias("shard"), F.col("depth").cast("int"), "shard_bytes"))
        if not leaves.where("over").take(1):
            break
        left = placed.where("over").select(key, "n_bytes", "bits")
        start = end
        if start == BITS:
            done.append(_same_hash(left, key, limit, salt))
            break
        left = cut(left, "shard-sizes")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _same_hash(left: DataFrame, key: str, limit: int, salt: int) -> DataFrame:
    """Rows of one hash, cut where running sums pass the limit; each of `salt` parts, more where there are more bytes, runs on its own, so none is one task."""
    left = cut(left, "shard-same")  # the salt must not change when a task runs again
    salt = max(salt, -(-(left.agg(F.sum("n_bytes")).first()[0] or 0) // max(limit, 1)), -(-left.count() // 1_000_000))
    dealt = cut(left.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salt))), "shard-salt")
    order = Window.partitionBy("bits", "salt").orderBy(F.desc("n_bytes"))
    # Every row counts as at least half the limit or its own size, whichever rule keeps each part within the limit:
    # two running sums of up to limit/2 never share a part with a third. A text of no bytes counts as one.
    half = F.greatest(F.lit(limit // 2), F.lit(1))
    before = F.coalesce(F.sum(F.greatest(F.least("n_bytes", half), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    big = F.col("n_bytes") > half
    part = F.when(big, F.concat_ws("-", F.lit("b"), F.row_number().over(order))).otherwise(F.concat_ws("-", F.lit("s"), F.floor(before / half)))
    parts = dealt.withColumn("part", part)
    held = F.sum("n_bytes").over(Window.partitionBy("bits", "salt", "part"))
    return parts.select(key, "n_bytes", F.concat_ws("-", "bits", "salt", "part").alias("shard"), F.lit(BITS).alias("depth"), held.alias("shard_bytes"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"))


#: A limit at which small tables split as well.
FINE_BYTES = 160 << 10


def sharding_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"), limit=FINE_BYTES, step=3)


def sharding_sql(limit: int) -> str:
    """For tables without a hash that alone is over the limit: parts of one hash ("-k") are tested by brute force."""
    return f"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), {BITS}, '0') AS bits
  FROM documents),
levels AS (SELECT range AS depth FROM range(0, {BITS + 1})),
sums AS (SELECT depth, substr(bits, 1, depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS held FROM sized, levels GROUP BY ALL),
leaf AS (
  SELECT s.rid, min(u.depth) AS depth FROM sized s, levels l
  JOIN sums u ON u.depth = l.depth AND u.prefix = substr(s.bits, 1, l.depth) AND u.held <= {limit}
  GROUP BY s.rid)
SELECT s.doc_id, s.n_bytes, u.prefix AS shard, CAST(u.depth AS INTEGER) AS depth, u.held AS shard_bytes
FROM sized s JOIN leaf USING (rid) JOIN sums u ON u.depth = leaf.depth AND u.prefix = substr(s.bits, 1, leaf.depth)
"""


OP5_SQL = sharding_sql(LIMIT_BYTES)
