"""Clustering around centroids in exact whole numbers, with centroids ruled out by norms of blocks.

Vectors are kept if they have the given number of components, none null, NaN or infinite; a
component x becomes floor(256 * x). A vector and a centroid are also compressed: of each block
of 8 components the mean (times the root of 8) and the norm of what the mean leaves. By
Cauchy-Schwarz, the squared distance of two vectors is not less than the squared distance of
their compressed forms:

    |x - c|^2 = sum over blocks of (m_x - m_c)^2 + |r_x|^2 + |r_c|^2 - 2 r_x.r_c
             >= sum over blocks of (m_x - m_c)^2 + (|r_x| - |r_c|)^2

These bounds, from norms that are computed once and stored, screen the centroids: the exact
distance to the one with the least bound rules out all whose bound is greater, and only those
left get an exact distance in whole numbers. So the nearest (of ties the smallest number) is
exact whatever the bounds are worth.

Rounds: each task assigns its vectors and sums them by cluster; the sums of all tasks are added
by Spark, so that a cluster with most vectors is no group of its own. Centroids are k rows.

Rows that repeat a vec_id are vectors each. A null vec_id is assigned like others but begins
no centroid. With fewer vectors than centroids, there are as many centroids as vectors with a
vec_id; without any, and for an empty table, there are no rows. Components beyond 524,288
count as that much, so that all distances are exact in 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, batches_of

WIDTH, BLOCK = 64, 8
CLUSTERS, ROUNDS = 40, 5
SCALE, LARGEST = 256, 1 << 27


def compressed(q: np.ndarray) -> np.ndarray:
    """Scaled mean, and norm of the rest, of each block of whole-number rows."""
    x = q.reshape(len(q), -1, BLOCK).astype(np.float64)
    mean = x.mean(2)
    rest = np.sqrt(((x - mean[:, :, None]) ** 2).sum(2))
    return np.concatenate((mean * np.sqrt(BLOCK), rest), 1)


def distance(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = q.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def nearest(q: np.ndarray, short: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, its squared distance, how many got an exact distance) of each row of ``q``, whose compressed form is ``short``."""
    small = compressed(centroids)
    norms = (short * short).sum(1)[:, None] + (small * small).sum(1)
    bound = norms - 2 * (short @ small.T)
    # what rounding may have added to a bound
    slack = norms * 1e-9 + 1
    first = bound.argmin(1)
    best = distance(q, centroids[first])
    left = bound - slack <= best[:, None]
    left[np.arange(len(q)), first] = False
    row, k = np.nonzero(left)
    where = np.concatenate((np.arange(len(q)), row))
    which, exact = np.concatenate((first, k)), np.concatenate((best, distance(q[row], centroids[k])))
    order = np.lexsort((which, exact, where))
    head = order[np.flatnonzero(np.diff(where[order], prepend=-1))]
    return which[head], exact[head], left.sum(1) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            short = compressed(_matrix(batch.column("q")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(short) + 1, dtype=np.int32) * short.shape[1]), pa.array(short.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), lists], ["vec_id", "q", "short"])


def _sum_up(centroids: np.ndarray):
    """For each task: of each cluster it has met, the number of its vectors and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                q = _matrix(batch.column("q"))
                k, _, _ = nearest(q, _matrix(batch.column("short")), centroids)
                np.add.at(sums, k, q)
                n += np.bincount(k, minlength=len(n))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met]), *(pa.array(sums[met, j]) for j in range(sums.shape[1]))], ["cluster", "n", *(f"s{j}" for j in range(sums.shape[1]))])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k, d, exact = nearest(_matrix(batch.column("q")), _matrix(batch.column("short")), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(k.astype(np.int32)), pa.array(d), pa.array(exact.astype(np.int32))], ["vec_id", "cluster", "distance", "n_exact"])

    return run


@dataclass
class Clustering:
    """``assigned`` (vec_id, cluster, distance, n_exact) of each vector; ``centroids``: one row of whole numbers each."""

    assigned: DataFrame
    centroids: np.ndarray


def whole_numbers(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vec_id, q) of the vectors that are kept."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.expr(f"x IS NOT NULL AND size(x) = {width} AND forall(x, y -> y IS NOT NULL AND NOT isnan(y) AND abs(y) < double('infinity'))")
    number = lambda y: F.floor(F.greatest(F.least(y * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    return v.where(fine).select("vec_id", F.transform("x", number).alias("q"))


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 2, width: int = WIDTH) -> Clustering:
    """Begins with the vectors whose sha256 of ``seed:vec_id`` is least, in that order."""
    spark = vectors.sparkSession
    batches_of(spark, rows=4096, size=4 << 20)
    space = Workspace(spark, "centroids")
    table = space.keep(whole_numbers(vectors, width).mapInArrow(_compress, "vec_id long, q array<int>, short array<double>"), "numbers")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    begin = table.where("vec_id IS NOT NULL").select(order.alias("place"), "q").orderBy("place", "q").limit(clusters).collect()
    centroids = np.array([r["q"] for r in begin], np.int64).reshape(len(begin), width)
    if not len(centroids):
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long, n_exact int"), centroids)
    columns = ", ".join(f"s{j} long" for j in range(width))
    for _ in range(rounds):
        parts = table.select("q", "short").mapInArrow(_sum_up(centroids), f"cluster int, n long, {columns}")
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(f"s{j}").alias(f"s{j}") for j in range(width))).collect():
            centroids[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return Clustering(space.keep(table.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long, n_exact int"), "assigned"), centroids)


def with_inertia(found: Clustering) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256; sums beyond 64 bits are null."""
    total = found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    per = {r["cluster"]: int(r["inertia"]) for r in total}
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(k, fits(per.get(k, 0)), fits(sum(per.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(found.centroids)]
    # one row a centroid
    about = found.assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact")
