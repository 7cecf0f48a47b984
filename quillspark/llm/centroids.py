"""Centroid clustering of integer vectors: float32 screening, exact where it matters.

Squared distances to all centroids come from one float32 matrix product for a block of
vectors. A computed inner product of n terms is off by at most ``g * sum(|x_i| |c_i|)`` with
``g = k u / (1 - k u)``, where u is float32's unit roundoff and k counts the roundings that a
term meets (n, for any order of summation, and two for the conversions); the sum is at most
the product of the two norms. This gives each vector and centroid an interval that surely
holds the distance. Centroids whose interval begins above the least end of all are out; if
one is left, it is the nearest. Otherwise the distances to those left are computed again in
64-bit integers, exactly, and the smallest number wins a tie.

Spark scans the vectors once for each round; what a task returns is the exact sums and count
of each centroid's vectors, so a hot vector or cluster weighs no more than others. The
centroids (``k * dimensions`` integers, both parameters) are all that the driver holds and
sends out.

Contract: a vector takes part if it has exactly ``dimensions`` components, none null or
non-finite. Components become ``floor(scale * x)``; one beyond 2**27 in size is refused with an
error, as distances might not fit in 64 bits then. Repeated rows are vectors of their own, null keys included
(they hash as the empty text); of equal hashes the vector with the smaller components, as
stored bytes, comes first. With fewer than ``k`` vectors there are as many centroids as
vectors; an empty table gives an empty result. Of the input, only key and vector are read, so
other columns' names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_arrow, materialize

#: Largest size of an integer component; 64 squares of a difference then fit in 64 bits.
LARGEST = 1 << 27
#: Vectors that are compared in one matrix product.
BLOCK = 4096
#: Float32's unit roundoff, and float64's machine epsilon.
_U, _EPS = 2.0**-24, float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Clustering:
    """``assigned`` (vec_id, cluster, distance), the final centroids and their totals of distances."""

    assigned: DataFrame
    centroids: list[list[int]]
    inertia: list[int]


def kept_vectors(rows: DataFrame, dimensions: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, as little-endian 32-bit integers."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            long_enough = np.asarray(lists.value_lengths().fill_null(-1)) == dimensions
            chosen = batch.filter(pa.array(long_enough))
            values = chosen.column(1).flatten()
            x = np.asarray(values.cast(pa.float64()).fill_null(np.nan)).reshape(-1, dimensions)
            good = np.isfinite(x).all(axis=1)
            whole = np.floor(scale * x[good])
            if np.abs(whole).max(initial=0) > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} after scaling")
            raw = whole.astype("<i4").tobytes()
            packed = [raw[i : i + 4 * dimensions] for i in range(0, len(raw), 4 * dimensions)]
            yield pa.RecordBatch.from_arrays([chosen.column(0).filter(pa.array(good)), pa.array(packed, pa.binary())], names=["vec_id", "v"])

    return in_arrow(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")), convert, "vec_id long, v binary")


def shortlist(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, open): the first centroid whose interval ends least, and which centroids may be nearest.

    The intervals are those of the squared distance less the vector's own square, which is the
    same for all centroids.
    """
    n = x.shape[1]
    k = n + 2  # roundings of a term: the sum's and the two conversions
    gamma = k * _U / (1 - k * _U)
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    squares = (centroids.astype(np.float64) ** 2).sum(axis=1)
    size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(squares)[None, :]
    near = squares[None, :] - 2 * product
    # Twice the product's error; the float64 steps and the bound's own roundings are far below the second term.
    radius = 2 * gamma * size + 4 * (n + 8) * _EPS * (size + squares[None, :])
    upper = near + radius
    return upper.argmin(axis=1), near - radius <= upper.min(axis=1)[:, None]


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector (rows of int64), the smallest number on ties."""
    out, candidates = shortlist(x, centroids)
    several = candidates.sum(axis=1) > 1
    if several.any():
        rows, numbers = np.nonzero(candidates[several])  # a row's centroids in ascending order
        difference = x[several][rows] - centroids[numbers]
        exact = np.full((int(several.sum()), len(centroids)), np.iinfo(np.int64).max)
        exact[rows, numbers] = (difference * difference).sum(axis=1)
        out[several] = exact.argmin(axis=1)
    return out


def _blocks(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.column(1).slice(at, BLOCK).to_pylist()
        yield at, np.frombuffer(b"".join(part), dtype="<i4").reshape(-1, dimensions).astype(np.int64)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the exact floor of each cluster's mean, empty ones as they were."""
    k, dimensions = centroids.shape
    parts = [pa.array(np.repeat(np.arange(k), dimensions), pa.int32()), pa.array(np.tile(np.arange(dimensions), k), pa.int32())]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
        for batch in batches:
            for _, x in _blocks(batch, dimensions):
                own = nearest(x, centroids)
                counts += np.bincount(own, minlength=k)
                order = np.argsort(own, kind="stable")
                found, first = np.unique(own[order], return_index=True)
                sums[found] += np.add.reduceat(x[order], first, axis=0)
        if counts.any():
            yield pa.RecordBatch.from_arrays([*parts, pa.array(np.repeat(counts, dimensions)), pa.array(sums.ravel())], names=["cluster", "dim", "n", "total"])

    made = in_arrow(vectors, add, "cluster int, dim int, n long, total long")
    # Decimals, as the sum over all tasks may not fit in 64 bits.
    whole = made.groupBy("cluster", "dim").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"), F.sum(F.col("total").cast("decimal(28,0)")).alias("total"))
    after = centroids.copy()
    for r in whole.where("n > 0").collect():  # k * dimensions rows
        after[r["cluster"], r["dim"]] = int(r["total"]) // int(r["n"])
    return after


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    dimensions = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _blocks(batch, dimensions):
                own = nearest(x, centroids)
                difference = x - centroids[own]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, BLOCK), pa.array(own, pa.int32()), pa.array((difference * difference).sum(axis=1), pa.int64())], names=["vec_id", "cluster", "distance"])

    return in_arrow(vectors, assign, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """Cluster the vectors around ``k`` centroids that move ``rounds`` times.

    The first centroids are the vectors whose ``<seed>:<vec_id>`` has the smallest sha256.
    """
    vectors = materialize(kept_vectors(rows, dimensions, scale, id_col, vector_col))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(key, "v").limit(k).collect()
    centroids = np.array([np.frombuffer(r["v"], dtype="<i4") for r in first], dtype=np.int64).reshape(-1, dimensions)
    if len(centroids):
        for _ in range(rounds):
            centroids = _moved(vectors, centroids)
        assigned = materialize(_assigned(vectors, centroids))
    else:
        assigned = rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long")
    discard(vectors)
    totals = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    return Clustering(assigned, centroids.tolist(), [totals.get(i, 0) for i in range(len(centroids))])


def with_totals(found: Clustering) -> DataFrame:
    """Each vector with its cluster's and all vectors' inertia, and the digest of its centroid."""
    spark, every = found.assigned.sparkSession, sum(found.inertia)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    rows = [(i, total, every, digest[i]) for i, total in enumerate(found.inertia)]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle_sql(k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The query, each round written out."""
    steps = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS k, e FROM v QUALIFY k < {k})",
    ]
    assign = lambda i: f"a{i} AS (SELECT r, min({{'d': d, 'k': k}}) AS m FROM (SELECT r, k, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{i} c) GROUP BY r)"
    for i in range(rounds):
        steps += [
            assign(i),
            f"u{i} AS (SELECT m.k AS k, generate_subscripts(e, 1) AS pos, unnest(e) AS x FROM a{i} JOIN v USING (r))",
            f"s{i} AS (SELECT k, pos, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM u{i} GROUP BY k, pos)",
            f"n{i} AS (SELECT k, list(x ORDER BY pos) AS e FROM s{i} GROUP BY k)",
            f"c{i + 1} AS (SELECT c{i}.k, coalesce(n{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN n{i} ON n{i}.k = c{i}.k)",
        ]
    return f"""
WITH {(", " + chr(10)).join([*steps, assign(rounds)])}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.k = m.k"""
