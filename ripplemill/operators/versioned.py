"""A vector index partitioned by model version: each version has cells of its own, and a search reads only the cells near its query.

The table is laid out by (version, cell). Cells are the regions nearest to some of a version's
own vectors, drawn by hash, about the square root of its vectors many but bounded. A query's
version and nearest cells are partition values, so other versions and cells are not read, and
no vector of another version can take a place among the nearest.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import cosine, nearest_pairs, ranked, tasks
from .working import shared_folder, written

MOST_CELLS = 1024
PROBES = 4
#: Vectors of a version for which each of its cells is one task's.
SHARE = 1_000_000


def _unit(column: pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _nearest_cells(shared, probes: int, names: list[str]):
    """Rows with the numbers of the ``probes`` nearest cells of their version."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for batch in batches:
            version, out = np.array(batch.column("version").to_pylist(), dtype=object), [None] * batch.num_rows
            for v in set(version.tolist()):
                at = np.flatnonzero(version == v)
                near = -_unit(batch.column("vec").take(pa.array(at))) @ seeds[v].T
                best = np.argsort(near, axis=1, kind="stable")[:, :probes]
                for i, row in zip(at, best.tolist()):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.list_(pa.int32()))], [*names, "cells"])

    return run


class VersionedIndex:
    """``vectors`` (vec_id, version, embedding) laid out by version and cell. Null vectors are not indexed; those of a version have one length."""

    def __init__(self, spark: SparkSession, path: str, seeds: dict):
        self.spark, self.path, self.seeds = spark, path, seeds

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, most_cells: int = MOST_CELLS, seed: int = 5) -> VersionedIndex:
        spark = vectors.sparkSession
        path = path or f"{shared_folder(spark)}/index-{time.time_ns()}"
        v = vectors.where(F.col("embedding").isNotNull() & F.col("version").isNotNull()).select("vec_id", "version", F.col("embedding").cast("array<float>").alias("vec"))
        sizes = v.groupBy("version").agg(F.count("*").alias("n"))
        # a vector's chance to be a cell's middle follows from its version's size, so the middles are bounded
        wanted = F.least(F.lit(most_cells), F.ceil(F.sqrt("n")))
        place = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_003))
        drawn = v.join(F.broadcast(sizes), "version").where(place * F.col("n") <= wanted * 1_000_003).select("version", "vec_id", "vec")
        # at least one a version, at most about most_cells
        one = v.groupBy("version").agg(F.min_by(F.struct("vec_id", "vec"), F.struct(place, "vec_id")).alias("x")).select("version", "x.*")
        middles: dict = {}
        for r in drawn.union(one).collect():
            middles.setdefault(r["version"], {})[r["vec_id"]] = r["vec"]
        seeds = {k: np.array([x[i] for i in sorted(x)], np.float32) for k, x in middles.items()}
        seeds = {k: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) for k, x in seeds.items()}
        index = cls(spark, path, seeds)
        # a cell's rows meet before they are written, so that not every task writes a file for every cell; a large version's cells are dealt to several tasks
        placed = index._near(v, 1).select("vec_id", "vec", "version", F.col("cells")[0].alias("cell")).join(F.broadcast(sizes), "version")
        dealt = placed.repartition(tasks(spark), "version", "cell", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / SHARE)))
        dealt.select("vec_id", "vec", "version", "cell").write.partitionBy("version", "cell").parquet(path)
        return index

    def _near(self, rows: DataFrame, probes: int) -> DataFrame:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cells array<int>"
        known = rows.where(F.col("version").isin(list(self.seeds)))
        return known.mapInArrow(_nearest_cells(self.spark.sparkContext.broadcast(self.seeds), probes, rows.columns), schema)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _met(self, queries: DataFrame, probes: int) -> tuple[DataFrame, DataFrame, list[str]]:
        """(near, found, key): queries by the cells that they ask for, the vectors of these cells, and what has to agree. Where a query asks for all cells, its version alone."""
        q = queries.where(F.col("q").isNotNull()).select("query_id", "version", F.col("q").cast("array<float>").alias("vec"))
        kind = dict(self.table().dtypes)["version"]
        if probes >= max((len(x) for x in self.seeds.values()), default=0):
            known = q.where(F.col("version").isin(list(self.seeds)))
            near, key = written(known.select("query_id", F.col("version").cast(kind).alias("version"), F.col("vec").alias("q")), "near"), ["version"]
        else:
            near = self._near(q, probes).select("query_id", F.col("version").cast(kind).alias("version"), F.explode("cells").alias("cell"), F.col("vec").alias("q"))
            near, key = written(near, "near"), ["version", "cell"]
        # at most all cells of the versions asked for: named in the filter, so that other partitions are not read
        wanted: dict = {}
        for r in near.select(*key).distinct().collect():
            wanted.setdefault(r[0], []).extend(r[1:])
        asked = F.lit(False)
        for v, cells in sorted(wanted.items(), key=lambda x: str(x[0])):
            asked = asked | ((F.col("version") == F.lit(v)) & (F.col("cell").isin(sorted(cells)) if cells else F.lit(True)))
        return near, self.table().where(asked), key

    def candidates(self, queries: DataFrame, probes: int = PROBES) -> DataFrame:
        """(query_id, vec_id, similarity) of all vectors in the nearest cells of each query (query_id, version, q), itself left out."""
        near, found, key = self._met(queries, probes)
        j = found.join(near, key).where("vec_id <> query_id")
        return j.select("query_id", "vec_id", F.round(cosine(F.col("q"), F.col("vec")), 9).alias("similarity"))

    def compared(self, queries: DataFrame, probes: int = PROBES) -> int:
        """How many rows ``candidates`` has, from the sizes of cells."""
        near, found, key = self._met(queries, probes)
        met = near.groupBy(*key).agg(F.count("*").alias("q")).join(found.groupBy(*key).agg(F.count("*").alias("n")), key).agg(F.sum(F.col("q") * F.col("n"))).first()[0]
        own = near.select(*key, F.col("query_id").alias("vec_id")).join(found.select(*key, "vec_id"), [*key, "vec_id"]).count()
        return (met or 0) - own

    def search(self, queries: DataFrame, k: int = 5, probes: int = PROBES, among: DataFrame | None = None) -> DataFrame:
        """Each query's k nearest (rank from 1) among the vectors of its version's nearest cells; with ``among`` (vec_id) among those of them."""
        near, found, key = self._met(queries, probes)
        found = found.withColumnRenamed("vec", "embedding")
        found = found if among is None else found.join(among, "vec_id", "left_semi")
        asked = near.select("query_id", "version", "q").distinct()
        best = ranked(nearest_pairs(found, near, k, ["version"], key[1:]), found, asked, k, ["version"])
        return best.withColumn("similarity", F.round("similarity", 9))


def exact(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest of each query's version, of all its vectors."""
    some = vectors.where(F.col("embedding").isNotNull())
    return ranked(nearest_pairs(some, queries, k, ["version"]), some, queries, k, ["version"]).select("query_id", "vec_id", "similarity", "rank")


def _card(truth: DataFrame, got: DataFrame, queries: int, k: int) -> tuple[float, float]:
    hits = truth.join(got.select("query_id", "vec_id"), ["query_id", "vec_id"]).count()
    return hits / max(1, queries * k), got.count() / max(1, queries)


def selectivity(vectors: DataFrame, queries: DataFrame, shares: list[float], k: int = 5, probes: int = PROBES) -> DataFrame:
    """(selectivity, search, recall, returned, read, ms): filtered search where that share of the vectors is of the queries' version.

    ``shared``: one index over all versions, whose ``k`` nearest are filtered afterwards;
    ``iterative``: the same, going on to more cells until k are left or all cells are read;
    ``own``: the index of the version. ``read``: vectors compared a query; ms include start-up.
    ``vectors`` (vec_id, embedding), ``queries`` (query_id, q).
    """
    spark, rows = vectors.sparkSession, []
    n = queries.count()
    for share in shares:
        version = F.when(F.pmod(F.xxhash64("vec_id", F.lit("share")), F.lit(10_000)) < int(share * 10_000), "target").otherwise("decoy")
        v = written(vectors.select("vec_id", "embedding", version.alias("version")), "versions")
        q = queries.select("query_id", "q", F.lit("target").alias("version"))
        truth = written(exact(v, q, k), "truth")
        everything = VersionedIndex.build(v.withColumn("version", F.lit("all")))
        own = VersionedIndex.build(v)
        mine = v.where("version = 'target'").select("vec_id")
        q_all = q.withColumn("version", F.lit("all"))
        cells = len(everything.seeds["all"])
        tried = [("shared", lambda: everything.search(q_all, k, probes).join(mine, "vec_id", "left_semi"), lambda: everything.compared(q_all, probes))]

        def iterate():
            p = probes
            while True:
                got = written(everything.search(q_all, k, p, mine), "iterated")
                if p >= cells or got.groupBy("query_id").count().where(F.col("count") >= k).count() >= n:
                    return got, p
                p = min(cells, 2 * p)

        for name, run, read in tried:
            began = time.perf_counter()
            got = written(run(), name)
            ms = 1000 * (time.perf_counter() - began) / max(1, n)
            rows.append((share, name, *_card(truth, got, n, k), read() / max(1, n), ms))
        began = time.perf_counter()
        got, p = iterate()
        rows.append((share, "iterative", *_card(truth, got, n, k), everything.compared(q_all, p) / max(1, n), 1000 * (time.perf_counter() - began) / max(1, n)))
        began = time.perf_counter()
        got = written(own.search(q, k, probes), "own")
        ms = 1000 * (time.perf_counter() - began) / max(1, n)
        rows.append((share, "own", *_card(truth, got, n, k), own.compared(q, probes) / max(1, n), ms))
    return spark.createDataFrame(rows, "selectivity double, search string, recall double, returned double, read double, ms double")
