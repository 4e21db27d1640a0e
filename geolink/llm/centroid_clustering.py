"""Operator 11: exact integer k-means with Elkan's bounds.

Vectors become integers, floor(scale * x).  Every round is one pass over a written
table that holds, beside each vector, its cluster, an upper bound of the distance to
its centroid and a lower bound to each of the k.  Centroids travel with the task
(k * dimensions numbers).  A centroid is skipped for a vector where

    upper < lower[j]   or   upper < half the distance of the two centroids

and only then is a distance computed, in 64-bit integers.  Bounds are floats rounded
outwards and the tests are strict, so a skipped centroid is truly farther: ties are
always computed and go to the smaller number.

Sums are exact and incremental: only vectors that changed their cluster are read again
(the flag reaches the Parquet scan), summed per task and then by Spark in decimals, so at
most k * dimensions numbers reach the driver.  Rounds end early when no centroid moves.

Defined results
    null vector, another length, null or non-finite components   no row
    null id         clustered like any other; comes last as a start
    repeated rows   each counts; equal ids start in the order of their vectors
    fewer than k vectors   as many clusters as vectors
    ties            the smaller cluster number
    empty clusters  keep their centroid
    integers beyond 2**27 in size   an error: squared distances would not fit in a long
    empty table     no rows
    extra columns   those named in ``keep`` are carried along; names of results are refused
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolink.llm.common import Scratch, carried, table

CLUSTERS, ROUNDS, SCALE, DIMS, SEED = 8, 10, 1024, 64, 3
#: Largest integer whose squared distances fit in a long; outward rounding of bounds.
LARGEST, SLACK = 1 << 27, 2.0**-50
RESULTS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_distances")


def usable(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null or non-finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) == dims) & F.forall(vector, finite)


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as an integer."""
    at = F.transform(vector, lambda c: F.floor(c * scale))
    fits = F.forall(at, lambda c: F.abs(c) <= LARGEST)
    return F.when(fits, F.transform(at, lambda c: c.cast("int"))).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("array<int>"))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def above(d: np.ndarray) -> np.ndarray:
    """The root of a squared distance or more."""
    return np.sqrt(d.astype(np.float64)) * (1 + SLACK)


def below(d: np.ndarray) -> np.ndarray:
    """The root of a squared distance or less."""
    return np.sqrt(d.astype(np.float64)) * (1 - SLACK)


def assign(x: np.ndarray, centre: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bring ``own``, ``upper`` and ``lower`` up to date with the centroids, in place.

    Returns the exact squared distances (-1 where none was needed) and how many were
    computed for each vector.
    """
    k = len(centre)
    half = np.stack([below(squared(centre, c)) for c in centre]) / 2 * (1 - SLACK)
    nearest = np.where(np.eye(k, dtype=bool), np.inf, half).min(axis=1)
    exact, computed = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)

    def tighten(rows: np.ndarray) -> None:
        exact[rows] = squared(x[rows], centre[own[rows]])
        upper[rows], lower[rows, own[rows]] = above(exact[rows]), below(exact[rows])
        computed[rows] += 1

    open_to = lambda rows, j: rows[(own[rows] != j) & (upper[rows] >= lower[rows, j]) & (upper[rows] >= half[own[rows], j])]
    active = np.nonzero(upper >= nearest[own])[0]
    for j in range(k):
        rows = open_to(active, j)
        tighten(rows[exact[rows] < 0])
        rows = open_to(rows, j)
        d = squared(x[rows], centre[j])
        lower[rows, j] = below(d)
        computed[rows] += 1
        wins = (d < exact[rows]) | ((d == exact[rows]) & (j < own[rows]))
        own[rows[wins]], exact[rows[wins]], upper[rows[wins]] = j, d[wins], above(d[wins])
    if last:
        tighten(np.nonzero(exact < 0)[0])
    return exact, computed


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _pass(state: DataFrame, centre: np.ndarray, before: np.ndarray, last: bool) -> DataFrame:
    """One round: bounds follow the centroids' moves, then assignment."""
    k, dims = centre.shape
    moved = above(squared(centre, before))
    kept = [f for f in state.schema.fields if f.name in ("vec_id", "_kept")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "x array<int>, cluster int, upper double, lower array<double>, distance bigint, n_distances bigint, was int, moved boolean"])

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), dims).astype(np.int64)
            was = batch.column("cluster").to_numpy(zero_copy_only=False)
            own = np.maximum(was, 0)
            upper = (batch.column("upper").to_numpy(zero_copy_only=False) + moved[own]) * (1 + SLACK)
            lower = np.maximum(_matrix(batch.column("lower"), k) - moved, 0) * (1 - SLACK)
            exact, computed = assign(x, centre, own, upper, lower, last)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            made = {
                "x": batch.column("x"), "cluster": pa.array(own, pa.int32()), "upper": pa.array(upper), "lower": pa.ListArray.from_arrays(ends, pa.array(lower.ravel())),
                "distance": pa.array(exact), "n_distances": pa.array(batch.column("n_distances").to_numpy() + computed), "was": pa.array(was, pa.int32()), "moved": pa.array(own != was),
            }
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made.values()], names=[*(f.name for f in kept), *made])

    return state.mapInArrow(run, schema)


def _changes(state: DataFrame, k: int, dims: int) -> list:
    """Per cluster and component what the vectors that moved bring and take: at most k * dims rows."""

    def run(batches):
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dims).astype(np.int64)
            own, was = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "was"))
            for j in range(k):
                total[j] += x[own == j].sum(axis=0) - x[was == j].sum(axis=0)
                n[j] += (own == j).sum() - (was == j).sum()
        j, at = (a.ravel() for a in np.indices((k, dims)))
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(at, pa.int32()), pa.array(total.ravel()), pa.array(np.repeat(n, dims))], names=["cluster", "at", "total", "n"])

    part = state.where("moved").select("x", "cluster", "was").mapInArrow(run, "cluster int, at int, total bigint, n bigint")
    return part.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()


def cluster(
    vectors: DataFrame, scratch: Scratch, *, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Cluster every usable vector: ``RESULTS`` and ``keep``.

    The start centroids are the k vectors with the smallest SHA-256 of ``seed:id``.
    ``n_distances`` counts the distances computed for the vector in all rounds.
    """
    vector = F.col(vec_col).cast("array<double>")
    rows = vectors.where(usable(vector, dims)).select(F.col(id_col).alias("vec_id"), whole(vector, scale).alias("x"), *carried(vectors, keep, RESULTS))
    rows = scratch.keep(rows, "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "x").select("x").limit(k).collect()
    centre = np.array([r.x for r in first], np.int64).reshape(len(first), dims)
    k = max(1, len(centre))
    if not len(centre):
        centre = np.zeros((1, dims), np.int64)
    none = F.lit(0).cast("bigint")
    state = rows.withColumns({"cluster": F.lit(-1), "upper": F.lit(float("inf")), "lower": F.array_repeat(F.lit(0.0), k), "n_distances": none})
    total, count, before = [[0] * dims for _ in range(k)], [0] * k, centre
    for r in range(rounds + 1):
        last = r == rounds or (r > 0 and (centre == before).all())
        state = scratch.keep(_pass(state, centre, before, last), f"round-{r}")
        scratch.drop(f"round-{r - 1}" if r else "vectors")
        if last:
            break
        for c in _changes(state, k, dims):
            total[c.cluster][c.at] += int(c.total)
            if c.at == 0:
                count[c.cluster] += c.n
        before = centre
        centre = np.array([[t // count[j] for t in total[j]] if count[j] else before[j] for j in range(k)], np.int64)
    sums = {c.cluster: int(c.total) for c in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centre]
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster"))
    return state.select(
        "vec_id", "cluster", "distance", of([sums.get(j, 0) for j in range(k)]).cast("bigint").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        of(digest).alias("centroid_sha256"), "n_distances", *(["_kept.*"] if keep else []),
    )


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """All usable embeddings in 8 clusters after 10 rounds."""
    return cluster(table(spark, sf_dir, "embeddings"), Scratch(spark, "op11")).drop("n_distances")


def _round(r: int) -> str:
    return f"""a{r} AS MATERIALIZED (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT rid, c, list_sum(list_transform(list_zip(x, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN c{r}) GROUP BY rid
), s{r} AS (
  SELECT c, i, sum(x[i]) AS t, count(*) AS n FROM a{r} JOIN v USING (rid), range(1, 65) AS g(i) GROUP BY c, i
), c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(k.m, c{r}.m) AS m FROM c{r} LEFT JOIN (SELECT c, list(((t - ((t % n + n) % n)) // n)::BIGINT ORDER BY i) AS m FROM s{r} GROUP BY c) AS k USING (c)
)"""


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) - 1 AS c, x AS m FROM v ORDER BY 1 LIMIT 8
), {", ".join(_round(r) for r in range(10))}, f AS (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT rid, c, list_sum(list_transform(list_zip(x, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN c10) GROUP BY rid
)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM f JOIN v USING (rid) JOIN c10 USING (c)
"""
