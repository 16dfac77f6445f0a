"""Centroid clustering of integer vectors with block-norm screening.

A component x becomes the integer floor(SCALE * x), so that sums and distances are exact. A vector
is cut into segments of equal length, and the norms of its segments are stored with it: its
compressed form. For a vector v and a centroid c with segments v_s and c_s,
``|v_s - c_s| >= ||v_s| - |c_s||`` (Cauchy-Schwarz), so the sum over s of
``(|v_s| - |c_s|)^2`` is a lower bound of their squared distance that takes one number a segment.
The centroid of the lowest bound gets its exact distance first; of the others only
those whose bound is not above that distance get exact ones. The bounds are lowered by
more than their rounding errors, so no nearest centroid is ever lost, and equal
distances are all compared.

Every round reads the same stored table and sends one row a cluster and task through
a sum that Spark combines before its shuffle. The driver sees the centroids, k rows of one vector,
and nothing that grows with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import quoted, stored

SCALE, SEGMENT = 256, 4
#: Largest size of an integer component: squared distances of 64 such components fit a long.
MOST = 1 << 27
#: Vectors whose bounds are held at once.
CHUNK = 4096


def integers(vector: Column) -> Column:
    """The integer components of an array of numbers."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.lit(float(SCALE)) * x))


def kept(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``id`` and integer components ``v`` of the vectors of exactly dim components, none null
    or non-finite, and none beyond MOST as an integer."""
    x = quoted(vector_col).cast("array<double>")
    limit = F.lit(MOST / SCALE)
    good = (F.size(x) == dim) & F.forall(x, lambda c: F.coalesce((c >= -limit) & (c < limit), F.lit(False)))  # NaN is above all numbers
    return vectors.filter(F.coalesce(good, F.lit(False))).select(quoted(id_col).alias("id"), integers(x).cast("array<int>").alias("v"))


def segment_norms(v: np.ndarray) -> np.ndarray:
    """The norms of the segments of integer vectors, a row each."""
    return np.sqrt(np.add.reduceat(np.square(v, dtype=np.int64), range(0, v.shape[1], SEGMENT), axis=1).astype(np.float64))


def compressed(vectors: DataFrame) -> DataFrame:
    """`kept` vectors with ``norms``, those of their segments."""

    def norm(segment: Column) -> Column:
        return F.sqrt(F.aggregate(segment, F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long")).cast("double"))

    starts = F.sequence(F.lit(1), F.size("v"), F.lit(SEGMENT))
    return vectors.select("id", "v", F.transform(starts, lambda at: norm(F.slice("v", at, F.lit(SEGMENT)))).alias("norms"))


def nearest(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector its nearest centroid (of equals the smaller number), the squared
    distance, and how many exact distances that took."""
    own = segment_norms(centroids)
    cluster, distance, exact = (np.zeros(len(v), dtype=np.int64) for _ in range(3))
    for at in range(0, len(v), CHUNK):
        x, n = v[at : at + CHUNK].astype(np.int64), norms[at : at + CHUNK]
        rows = np.arange(len(x))
        bound = np.zeros((len(x), len(centroids)))
        for s in range(n.shape[1]):
            bound += np.square(n[:, s, None] - own[None, :, s])
        bound -= 1e-12 * (np.square(n).sum(axis=1)[:, None] + np.square(own).sum(axis=1)[None, :]) + 1e-9
        likely = bound.argmin(axis=1)
        first = np.square(x - centroids[likely]).sum(axis=1)
        open_ = bound <= first[:, None]
        open_[rows, likely] = False
        i, j = np.nonzero(open_)
        found = np.full(bound.shape, np.iinfo(np.int64).max)
        found[rows, likely] = first
        for part in range(0, len(i), CHUNK * 8):
            a, b = i[part : part + CHUNK * 8], j[part : part + CHUNK * 8]
            found[a, b] = np.square(x[a] - centroids[b]).sum(axis=1)
        best = found.argmin(axis=1)  # the first of equals
        cluster[at : at + CHUNK], distance[at : at + CHUNK], exact[at : at + CHUNK] = best, found[rows, best], open_.sum(axis=1) + 1
    return cluster, distance, exact


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`compressed` vectors with ``cluster``, ``distance`` and ``n_exact``, the number of exact
    distances."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = nearest(_matrix(batch.column("v"), batch.num_rows), _matrix(batch.column("norms"), batch.num_rows), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, found)], names=["id", "cluster", "distance", "n_exact"])

    kind = table.schema["id"].dataType.simpleString()
    return table.mapInArrow(assign, f"id {kind}, cluster long, distance long, n_exact long")


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: those with vectors at the componentwise floor of their
    mean, the others where they were."""
    k, dim = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), batch.num_rows).astype(np.int64)
                cluster = nearest(v, _matrix(batch.column("norms"), batch.num_rows), centroids)[0]
                np.add.at(sums, cluster, v)
                counts += np.bincount(cluster, minlength=k)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own]), pa.array(list(sums[own]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = table.select("v", "norms").mapInArrow(add, "cluster long, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)])
    after = centroids.copy()
    for row in totals.collect():  # k rows at most
        after[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dim)]
    return after


def start(table: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest sha256 of ``seed:id``, equal ones by their components;
    a null id comes last."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = table.select("v", place.alias("place")).orderBy(F.col("place").asc_nulls_last(), "v").limit(k).collect()  # k vectors
    return np.array([r["v"] for r in rows], dtype=np.int64)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: the id, ``cluster``, ``distance`` (squared, of integers) to its
    centroid, ``n_exact``, ``cluster_inertia`` and ``inertia`` (distances summed over the cluster
    and over all) and ``centroid_sha256`` of the final centroid's components.

    Vectors of another length than dim, with a null, NaN or infinite component or a null array, and
    those with an integer component beyond MOST in size are left out. Repeated rows are vectors of
    their own. A null id takes part, but starts a centroid only where there are fewer than k other vectors;
    with fewer than k vectors each of them is a centroid. Of equally near centroids the
    smaller number counts; empty ones stay in place. Other columns, whatever their names, are not
    read. An empty table gives an empty one.
    """
    table = stored(compressed(kept(vectors, id_col, vector_col, dim)), "compressed")
    centroids = start(table, k, seed)
    if not len(centroids):
        return table.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("n_exact", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        centroids = moved(table, centroids)
    result = stored(assigned(table, centroids), "assigned")
    sums = {r["cluster"]: r["s"] for r in result.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    facts = [(n, sums.get(n, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for n, c in enumerate(centroids)]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster long, cluster_inertia long, inertia long, centroid_sha256 string")
    full = result.join(F.broadcast(facts), "cluster")  # k rows
    return full.select(F.col("id").alias(id_col), F.col("cluster").cast("int").alias("cluster"), "distance", "n_exact", "cluster_inertia", "inertia", "centroid_sha256")
