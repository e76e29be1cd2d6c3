"""Cosine search in a table of vectors filtered by model version."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Vectors of one block, queries of one block, and how far below a block's k-th best a vector is still compared in full.
BLOCK, QUERY_BLOCK, SLACK = 4096, 1024, 1e-8
_PLAIN = "(v is not null AND size(v) > 0 AND forall(v, x -> x is not null AND abs(x) < 1e18) AND exists(v, x -> abs(x) > 1e-18))"


def tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _matrix(column: pa.ListScalar) -> np.ndarray:
    rows = column.values
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best_of_blocks(k: int, key: list[str]):
    """(key, query_id, vec_id) of each query's k best of each block of vectors, and what is as near as rounding could tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, wanted = (batch.column(c)[i].values.to_numpy() for c in ("ids", "wanted"))
                near = _matrix(batch.column("q")[i]) @ _matrix(batch.column("v")[i]).T
                near[wanted[:, None] == ids] = -np.inf
                least = np.partition(near, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(near), -2.0)
                a, b = np.nonzero(near >= np.maximum(least, -2.0)[:, None] - SLACK)
                yield pa.RecordBatch.from_arrays([*(pa.repeat(batch.column(c)[i], len(a)) for c in key), pa.array(wanted[a]), pa.array(ids[b]), pa.array(near[a, b])], [*key, "query_id", "vec_id", "near"])

    return run


def nearest_pairs(vectors: DataFrame, queries: DataFrame, k: int, key: list[str], within: list[str] | None = None) -> DataFrame:
    """(key, query_id, vec_id): pairs among which each query's k nearest of equal ``key`` are, for an exact comparison.

    With ``within`` only rows that agree in those columns too are compared (buckets, cells); a
    pair that meets in several is one pair. Blocks of vectors meet blocks of queries, each pair
    as one product of matrices; vectors of other lengths than the query's, with nulls or without
    direction are all given back. ``vectors`` (vec_id, key, within, embedding), ``queries``
    (query_id, key, within, q).
    """
    part = [*key, *(within or [])]
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in part])
    v = vectors.where(known).select("vec_id", *part, F.col("embedding").alias("v")).withColumns({"fine": F.coalesce(F.expr(_PLAIN), F.lit(False)), "length": F.size("v")})
    q = queries.where(known).select("query_id", *part, F.col("q").alias("v")).withColumns({"fine": F.coalesce(F.expr(_PLAIN), F.lit(False)), "length": F.size("v")})
    sizes = v.where("fine").groupBy(*part, "length").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    spread = lambda c, n: F.pmod(F.xxhash64(c), n)
    packed = v.where("fine").join(F.broadcast(sizes), [*part, "length"]).groupBy(*part, "length", spread("vec_id", F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("x"))
    counts = q.where("fine").groupBy(*part, "length").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts"))
    asked = q.where("fine").join(F.broadcast(counts), [*part, "length"]).groupBy(*part, "length", spread("query_id", F.col("parts")).alias("part")).agg(F.collect_list(F.struct("query_id", "v")).alias("y"))
    # one row a pair of blocks, spread before they are multiplied
    asked = asked.join(F.broadcast(sizes), [*part, "length"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = packed.join(asked, [*part, "length", "block"]).select(*key, F.col("x.vec_id").alias("ids"), F.col("x.v").alias("v"), F.col("y.query_id").alias("wanted"), F.col("y.v").alias("q")).repartition(tasks(vectors.sparkSession))
    schema = ", ".join(f"{c} {dict(vectors.dtypes)[c]}" for c in key) + f", query_id {dict(queries.dtypes)['query_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, near double"
    # a query's best of each block, thinned out to its best of all
    near = met.mapInArrow(_best_of_blocks(k, key), schema)
    if within:
        near = near.groupBy(*key, "query_id", "vec_id").agg(F.max("near").alias("near"))
    order = Window.partitionBy("query_id").orderBy(F.desc("near"))
    near = near.withColumn("place", F.row_number().over(order))
    near = near.withColumn("least", F.max(F.when(F.col("place") == k, F.col("near"))).over(Window.partitionBy("query_id"))).where(F.col("least").isNull() | (F.col("near") >= F.col("least") - SLACK)).select(*key, "query_id", "vec_id")
    same = reduce(Column.__and__, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in part])
    other = v.alias("a").join(q.alias("b"), same).where("NOT a.fine OR NOT b.fine OR a.length <> b.length")
    return near.union(other.where("vec_id <> query_id").select(*[f"a.{c}" for c in key], "query_id", "vec_id")).distinct()


def ranked(pairs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, key: list[str]) -> DataFrame:
    """Pairs (key, query_id, vec_id) compared in full: each query's k nearest."""
    j = pairs.join(vectors.select(*key, "vec_id", "embedding"), [*key, "vec_id"]).join(queries.select(*key, "query_id", "q"), [*key, "query_id"]).select("query_id", "vec_id", cosine(F.col("q"), F.col("embedding")).alias("similarity"))
    # ordered by nine places, given whole: rounded once more, nine places would be rounded twice
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id")
    return j.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Exact: each query (query_id, q, label) with its k nearest vectors of the same label, itself left out."""
    return ranked(nearest_pairs(vectors, queries, k, ["label"]), vectors, queries, k, ["label"])


def approximate(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = 16, together: int = 2, width: float = 0.25, seed: int = 11) -> DataFrame:
    """As ``top_k``, among the vectors that share a bucket with the query in one of ``tables`` tables.

    Vectors are brought to length 1 and hashed by random projections, ``together`` of them a
    table; what is found is ranked by the exact similarity. Null vectors are near to nothing.
    """
    unit = Normalizer(inputCol="x", outputCol="unit", p=2.0)
    lsh = BucketedRandomProjectionLSH(inputCol="unit", outputCol="h", bucketLength=width, numHashTables=tables * together, seed=seed)
    v = unit.transform(vectors.where(F.col("embedding").isNotNull()).withColumn("x", array_to_vector(F.transform("embedding", lambda y: y.cast("double")))))
    q = unit.transform(queries.where(F.col("q").isNotNull()).withColumn("x", array_to_vector(F.transform("q", lambda y: y.cast("double")))))
    if v.isEmpty():
        return top_k(vectors, queries, k).where("false")
    model = lsh.fit(v)
    each = lambda df: model.transform(df).withColumn("h", F.transform("h", lambda y: vector_to_array(y)[0].cast("long")))
    keys = F.posexplode(F.array(*[F.xxhash64(F.slice("h", 1 + t * together, together)) for t in range(tables)])).alias("table", "bucket")
    # rows meet in each of their buckets by blocks: what is found does not depend on how often two rows share one
    near = nearest_pairs(each(v).select("vec_id", "label", "embedding", keys), each(q).select("query_id", "label", "q", keys), k, ["label"], ["table", "bucket"])
    return ranked(near, vectors, queries, k, ["label"]).withColumn("similarity", F.round("similarity", 9))


def not_embedded(nodes: DataFrame, embeddings: DataFrame, key: list[str]) -> DataFrame:
    return nodes.join(embeddings, key, "left_anti")


def recall_at_k(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    a = exact.groupBy("query_id").agg(F.collect_set("vec_id").alias("a"))
    b = approximate.groupBy("query_id").agg(F.collect_set("vec_id").alias("b"))
    return a.join(b, "query_id", "left").agg(F.avg(F.coalesce(F.size(F.array_intersect("a", "b")), F.lit(0)) / F.size("a")).alias("recall"))
