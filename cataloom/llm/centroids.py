"""Centroid clustering of vectors in exact integers; the nearest centroid is found by Orchard's search.

Each centroid has a list of the others by their distance to it. A vector begins at a centroid and goes through its list; a
centroid that is closer (or as close and of smaller number) takes its place, and the search goes on from the start of that
one's list. Centroids met before are marked and not measured again. A list ends where its centroids are strictly beyond twice
the distance held: by the triangle inequality no centroid from there on is closer, or as close. All vectors of a batch move
at once, each in its own list. Squared distances are compared, as integers: D > 4 * d.

A round is one pass over the vectors: tasks keep sums and counts for each centroid, and the driver gets those of all tasks
added up, one row for each centroid and component. No row is shuffled, and a hot cluster is only a larger sum.

Kept are vectors with `dims` components, none null or non-finite, and none that is 2^26 or more once scaled: their squared
distances could pass 64 bits. Repeated rows count as often as they occur; first centroids go by hash, vec_id and vector, so
that ties can't change them; a null id is hashed as an empty text. With fewer vectors than `k` there are as many centroids as vectors; without any,
and for empty tables, no rows. Columns other than vec_id and embedding are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, read

DIMS, K, ROUNDS, SCALE = 64, 16, 3, 64
REACH = 1 << 26
ROWS = 4096
#: A task's sums of so many vectors are handed on: 2^35 components below 2^26 stay within 64 bits.
FULL = 1 << 35


def vectors(table: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that are kept; v holds the floor of each scaled component."""
    number = F.col("embedding").cast("array<double>")
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < REACH)
    kept = table.where((F.size("embedding") == dims) & F.forall(number, fits))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(number, lambda x: F.floor(x * scale)).alias("v"))


def first_centroids(rows: DataFrame, k: int = K, seed: str = "1:") -> np.ndarray:
    """The `k` vectors of least hash, by hash."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in rows.orderBy(digest, "vec_id", "v").limit(k).select("v").collect()], np.int64)


class Orchard:
    """Lists of all centroids, and the search in them."""

    def __init__(self, centroids: np.ndarray):
        self.at = centroids
        self.between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        self.lists = np.argsort(self.between, axis=1, kind="stable")

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each point; of equally near centroids the smallest number."""
        n, k = len(points), len(self.at)
        best = np.zeros(n, np.int64)
        held = ((points - self.at[0]) ** 2).sum(axis=1)
        place = np.zeros(n, np.int64)
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        active = np.arange(n)
        while len(active):
            here, spot = best[active], place[active]
            other = self.lists[here, spot]
            going = self.between[here, other] <= 4 * held[active]
            active, other = active[going], other[going]
            new = ~visited[active, other]
            asked, which = active[new], other[new]
            visited[asked, which] = True
            distance = ((points[asked] - self.at[which]) ** 2).sum(axis=1)
            closer = (distance < held[asked]) | ((distance == held[asked]) & (which < best[asked]))
            place[active] += 1
            jump = asked[closer]
            best[jump], held[jump], place[jump] = which[closer], distance[closer], 0
            active = active[place[active] < k]
        return best, held


def _points(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index("v"))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: each that has vectors is at the floor of their mean."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)

        def out() -> pa.RecordBatch:
            used = np.flatnonzero(count)
            return pa.RecordBatch.from_pydict({"cluster": used, "n": count[used], "total": list(total[used])}, pa.schema([("cluster", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

        for part in _parts(batches):
            points = _points(part)
            cluster, _ = search.nearest(points)
            order = np.argsort(cluster, kind="stable")
            used, start = np.unique(cluster[order], return_index=True)
            total[used] += np.add.reduceat(points[order], start, axis=0)
            count += np.bincount(cluster, minlength=k)
            if count.sum() > FULL:
                yield out()
                total[:], count[:] = 0, 0
        yield out()

    parts = rows.select("v").mapInArrow(sums, "cluster long, n long, total array<long>")
    added = parts.select("cluster", "n", F.posexplode("total").alias("c", "x")).groupBy("cluster", "c").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    after = centroids.copy()
    for r in added.collect():  # k x dims rows
        after[r.cluster, r.c] = int(r.x) // int(r.n)
    return after


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for part in _parts(batches):
            cluster, distance = search.nearest(_points(part))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(table: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept."""
    rows = vectors(table, dims, scale)
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = cut(assigned(rows, centroids), "clusters")
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    sums = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row for each centroid
    facts = [(c, sums.get(c, 0), sum(sums.values()), digest) for c, digest in digests]
    return found.join(F.broadcast(rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))


def centroids_sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> str:
    """The same in SQL, where each vector is measured against each centroid."""
    nearest = lambda c: f"""
        SELECT row_, min_by(cluster, d * {k} + cluster)::INT AS cluster, min(d)::BIGINT AS distance FROM (
            SELECT kept.row_, {c}.cluster, list_sum(list_transform(list_zip(kept.v, {c}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM kept, {c}) GROUP BY row_"""  # noqa: E731
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({nearest(f'c{n}')})")
        steps.append(f"""c{n + 1} AS MATERIALIZED (
            SELECT c{n}.cluster, coalesce(means.v, c{n}.v) AS v FROM c{n} LEFT JOIN (
                SELECT cluster, list(m ORDER BY part) AS v FROM (
                    SELECT cluster, part, (sum(x) // count(*) - CASE WHEN sum(x) < 0 AND sum(x) % count(*) <> 0 THEN 1 ELSE 0 END)::BIGINT AS m
                    FROM (SELECT a{n}.cluster, unnest(kept.v) AS x, unnest(range({dims})) AS part FROM a{n} JOIN kept USING (row_)) GROUP BY cluster, part)
                GROUP BY cluster) AS means USING (cluster))""")
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS row_, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
    c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, vec_id, v) - 1)::INT AS cluster, v FROM (SELECT sha256('1:' || vec_id) AS h, vec_id, v FROM kept ORDER BY h, vec_id, v LIMIT {k})),
    {", ".join(steps)},
    last AS MATERIALIZED ({nearest(f"c{rounds}")})
    SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
           sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
    FROM last JOIN kept USING (row_) JOIN c{rounds} USING (cluster)"""


OP11_SQL = centroids_sql()
