"""What the corpus operators share: working tables, size-checked broadcasts, components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.working import shared_folder

#: A side of a join is broadcast only if it has been counted and has at most so many values.
BROADCAST_ROWS = 200_000
#: Spark's setting for deleting a query's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def batches_of(spark: SparkSession, rows: int = 256, size: int = 1 << 20) -> None:
    """Bound the Arrow batches that Python tasks get, in rows and in bytes, so that memory depends on neither count nor length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Workspace:
    """Tables written to the shared folder, which survive the loss of an executor.

    A written table also ends the plan behind it, so that nothing is computed twice.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        with self._cleaning():
            df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    @contextmanager
    def _cleaning(self):
        """Nothing reads the plan again, so its shuffle files go as soon as it is written."""
        before = self.spark.conf.get(CLEAN_UP, None)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(CLEAN_UP) if before is None else self.spark.conf.set(CLEAN_UP, before)

    def keep_dealt(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Like ``keep``, dealt into buckets by ``key``: joins on it don't shuffle this side again."""
        table = f"{name}_{uuid.uuid4().hex}"
        with self._cleaning():
            df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", f"{self.root}/{name}").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def buckets_for(df: DataFrame, text: str, size: int = 32 << 20) -> int:
    """As many parts as there are ``size`` bytes in a column."""
    total = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return min(100_000, 1 + int(total) // size)


def broadcast_if_small(df: DataFrame, values: int) -> DataFrame:
    """``values``: the counted number of values in ``df``. Beyond the bound Spark joins by shuffling."""
    return F.broadcast(df) if values <= BROADCAST_ROWS else df


def components(edges: DataFrame, space: Workspace, name: str = "components") -> DataFrame:
    """(node, component): each node of ``edges`` (a, b) with the smallest node reachable.

    Alternating large-star and small-star steps, until every edge leads from a node straight
    to the least of its component: each edge set is written to the shared folder, nothing
    but a number a round comes to the driver, and the edges of a node with very many
    neighbours are never gathered (joins that Spark can split, and sums). Each round at
    least halves the distances, so there is no limit of rounds.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, k = space.keep(edges, f"{name}-0"), 0
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").isEmpty():
            break
        k += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # no duplicates but those of one step: the next one takes the least anyway
        large = space.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), f"{name}-large-{k}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).distinct()
        edges = space.keep(small, f"{name}-{k}")
        space.drop(f"{name}-{k - 1}")
        space.drop(f"{name}-large-{k}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
