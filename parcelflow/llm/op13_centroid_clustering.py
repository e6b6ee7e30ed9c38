"""Clustering around centroids by equal-average equal-variance search, in whole numbers.

A vector becomes whole numbers, floor(64 * x). For each centroid its sum and deviation are known; centroids are sorted by
sum. A vector looks outward from its own sum: with k components, squared distance d and W = sqrt(k * sum of squares - sum^2),
k * d >= (difference of sums)^2 ends the search on both sides, and k * d >= (difference of sums)^2 + (difference of W)^2
rejects one centroid. What isn't rejected is measured exactly; ties go to the smaller number. The bounds only spare work: W
is rounded so that it never rejects a centroid as near as the best.

Every round is one pass over the table: a task adds up its vectors by cluster and component, so at most centroids times
components rows leave it. The centroids, 16 times 64 numbers, are all that the driver holds and sends back.

Defined results: vectors that are null, of another length, or that hold a null, NaN or infinite component are left out; a
component beyond 2^18 either way stands for that bound, so that distances fit 64 bits; a null id is like an empty one in
the order of first centroids, equal ids are ordered by their components; repeated rows are vectors of their own; with fewer
vectors than centroids there are as many centroids as vectors; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
BOUND = 1 << 24  # of a component, scaled


def integers(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that are kept."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.size(whole) == dim
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(whole, lambda x: F.floor(F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), x * scale))).cast("int"))
    return embeddings.where(fine & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id; ``count`` rows reach the driver."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(place.alias("place"), "v").orderBy("place", "v").limit(count).collect()
    return np.array([r.v for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid."""
    n, dim = x.shape
    order = np.argsort(centroids.sum(axis=1), kind="stable")
    c = centroids[order]
    cs, xs = c.sum(axis=1), x.sum(axis=1)
    deviation = lambda v, s: np.sqrt((dim * (v * v).sum(axis=1) - s * s).astype(np.float64))
    cw, xw = deviation(c, cs), deviation(x, xs)
    right = np.searchsorted(cs, xs)
    left = right - 1
    best, who = np.full(n, dim * (2 * BOUND) ** 2, np.int64), np.full(n, len(c), np.int64)
    live, none = np.arange(n), np.int64(1) << 40
    while len(live):
        a, b = left[live], right[live]
        before = np.where(a >= 0, xs[live] - cs[a], none)
        after = np.where(b < len(c), cs[np.minimum(b, len(c) - 1)] - xs[live], none)
        to_left = before <= after
        gap = np.minimum(before, after)
        go = gap < none
        go[go] = gap[go] ** 2 <= dim * best[live[go]]
        live, gap, to_left, at = live[go], gap[go], to_left[go], np.where(to_left, a, b)[go]
        left[live[to_left]] -= 1
        right[live[~to_left]] += 1
        apart = np.maximum(np.abs(xw[live] - cw[at]) - 1e-5, 0.0)
        near = (gap.astype(np.float64) ** 2 + apart**2) * (1 - 1e-12) <= (dim * best[live]).astype(np.float64)
        rows, at = live[near], at[near]
        d, number = ((x[rows] - c[at]) ** 2).sum(axis=1), order[at]
        better = (d < best[rows]) | ((d == best[rows]) & (number < who[rows]))
        best[rows[better]], who[rows[better]] = d[better], number[better]
    return who, best


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def _sums(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                who, _ = nearest(x, centroids)
                np.add.at(sums, who, x)
                counts += np.bincount(who, minlength=len(counts))
        k, dim = np.flatnonzero(counts), centroids.shape[1]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(k, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(k)), pa.int32()), pa.array(sums[k].ravel()), pa.array(np.repeat(counts[k], dim)),
        ], names=["cluster", "component", "total", "n"])

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floor of its vectors' mean, where it has any."""
    part = vectors.select("v").mapInArrow(_sums(centroids), "cluster int, component int, total long, n long")
    whole = part.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in whole.collect():  # centroids times components
        out[r.cluster, r.component] = int(r.total) // r.n
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                who, best = nearest(_matrix(batch), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(who.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, as a staged table, and the centroids."""
    vectors = integers(embeddings, dim, scale)
    centroids = first_centroids(vectors, count, seed)
    if not len(centroids):
        return vectors.selectExpr("vec_id", "0 as cluster", "0L as distance"), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    return staged(assigned(vectors, centroids)), centroids


def clusters(embeddings: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = cluster(embeddings, **how)
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster")).cast(kind)
    per, everything = [sums.get(k, 0) for k in range(len(digests))] or [0], sum(sums.values())
    return rows.select("vec_id", "cluster", "distance", of(per, "long").alias("cluster_inertia"), F.lit(everything).cast("long").alias("inertia"), of(digests or [""], "string").alias("centroid_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT r, cluster, CAST(sum((x - cx) * (x - cx)) AS BIGINT) AS distance FROM l JOIN c{k} USING (i) GROUP BY r, cluster),
a{k} AS MATERIALIZED (SELECT r, cluster, distance FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN l USING (r) GROUP BY cluster, i),
c{k + 1} AS MATERIALIZED (SELECT cluster, i, CASE WHEN n IS NULL THEN cx ELSE (s - ((s % n) + n) % n) // n END AS cx FROM c{k} LEFT JOIN s{k} USING (cluster, i))""")
    body = ",\n".join(steps)
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
l AS MATERIALIZED (SELECT r, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM v, range(1, {DIM + 1}) t(i)),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS cluster FROM v QUALIFY cluster < {CENTROIDS}),
c0 AS MATERIALIZED (SELECT cluster, i, x AS cx FROM f JOIN l USING (r)),
{body},
h AS (SELECT cluster, sha256(string_agg(CAST(cx AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN h USING (cluster)
"""


SQL = _sql()
