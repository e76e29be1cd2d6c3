"""Fitting the text classifiers on a bounded sample of labelled documents, and scoring all documents.

A learner goes over fixed shards of the sample at the same time; after each pass tasks
average, for each coordinate, the changes of the shards that saw it, a slab of coordinates a
group. The driver holds the model (2**18 coordinates) and gets one slab after another, never
documents or the shards' own changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, batches_of
from .linear import Ftrl
from .words import in_pieces

#: Labelled documents used, at most, and bytes of their texts. They are those whose hashed doc_id is least.
MAX_TRAINING_DOCS = 12_000
MAX_TRAINING_BYTES = 96 << 20
SHARDS = 4
#: Coordinates whose changes are averaged together, and tasks that write the averages of a pass.
SLAB, WRITERS = 1 << 13, 4


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the doc_id as text; a null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_docs(docs: DataFrame, labels: DataFrame, label: str, held: Column, max_docs: int) -> DataFrame:
    """(shard, rank, text, y) of the sample. Conflicting labels of one doc_id count as 1; null labels as none."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = known.withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(max_docs)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    # the sample's bound is the bound of what is broadcast
    rows = text.join(F.broadcast(picked), "doc_id")
    # where the bytes are enough, by rank; a window over the sample's lengths alone, repeated doc_ids counted each
    upto = F.sum("bytes").over(Window.orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    lengths = rows.groupBy("rank").agg(F.sum(F.octet_length("text")).alias("bytes"))
    held = F.coalesce(F.col("upto"), F.lit(0)) <= MAX_TRAINING_BYTES
    last, first = lengths.withColumn("upto", upto).agg(F.max(F.when(held, F.col("rank"))), F.min("rank")).first()
    # a first document that is larger by itself is the sample
    rows = rows.where(F.col("rank") <= F.lit(last if last is not None else first))
    return rows.select((F.pmod("rank", F.lit(SHARDS * 7919)) % SHARDS).cast("int").alias("shard"), "rank", "y", "text")


def _shard_learner(learn: Callable, options: tuple, state):
    def one_shard(table: pa.Table) -> pa.Table:
        z, n = state.value
        own = Ftrl(*options, z=z.copy(), n=n.copy())
        for row in table.sort_by([("rank", "ascending"), ("y", "ascending")]).to_batches(max_chunksize=256):
            c = {k: row.column(k).to_pylist() for k in ("a", "b", "kinds", "y")}
            learn(own, [(np.frombuffer(a, k.split()[0]), np.frombuffer(b, k.split()[1]), y) for a, b, k, y in zip(c["a"], c["b"], c["kinds"], c["y"])])
        i = np.flatnonzero((own.n != n) | (own.z != z))
        cuts = np.searchsorted(i, np.arange(0, len(z) + SLAB, SLAB))
        parts = [(k, i[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        shard, changes = table["shard"][0].as_py(), (own.z - z, own.n - n)
        return pa.table(
            [pa.array([k for k, _ in parts], pa.int32()), pa.array([shard] * len(parts), pa.int32()), pa.array([p.astype(np.int32).tobytes() for _, p in parts], pa.binary()), *(pa.array([c[p].tobytes() for _, p in parts], pa.binary()) for c in changes)],
            names=["slab", "shard", "i", "dz", "dn"],
        )

    return one_shard


def _averaged(table: pa.Table) -> pa.Table:
    """Of one slab's coordinates the mean change of the shards that saw them."""
    z, n, seen = np.zeros(SLAB), np.zeros(SLAB), np.zeros(SLAB)
    slab = table["slab"][0].as_py()
    for row in table.sort_by("shard").to_pylist():
        i = np.frombuffer(row["i"], np.int32) - slab * SLAB
        seen[i] += 1
        z[i] += np.frombuffer(row["dz"])
        n[i] += np.frombuffer(row["dn"])
    seen = np.maximum(seen, 1)
    return pa.table({"slab": pa.array([slab], pa.int32()), "dz": [(z / seen).tobytes()], "dn": [(n / seen).tobytes()]})


def fit(sample: DataFrame, examples: Callable, learn: Callable, model: Ftrl, passes: int) -> Ftrl:
    """``examples(texts)`` gives two arrays a text; ``learn(model, [(a, b, y)])`` goes over them once."""
    spark = sample.sparkSession
    batches_of(spark)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, limit=1 << 20):
            pairs = examples(piece.column("text").to_pylist())
            a, b = (pa.array([x[k].tobytes() for x in pairs], pa.binary()) for k in (0, 1))
            kinds = pa.array([f"{x[0].dtype.str} {x[1].dtype.str}" for x in pairs])
            yield pa.RecordBatch.from_arrays([piece.column("shard"), piece.column("rank"), piece.column("y"), a, b, kinds], ["shard", "rank", "y", "a", "b", "kinds"])

    space = Workspace(spark, "fit")
    features = space.keep(sample.mapInArrow(featurise, "shard int, rank long, y int, a binary, b binary, kinds string"), "features")
    options = (model.alpha, model.beta, model.l1, model.l2)
    for k in range(passes):
        state = spark.sparkContext.broadcast((model.z, model.n))
        changes = features.groupBy("shard").applyInArrow(_shard_learner(learn, options, state), "slab int, shard int, i binary, dz binary, dn binary")
        means = changes.groupBy("slab").applyInArrow(_averaged, "slab int, dz binary, dn binary").coalesce(WRITERS)
        z, n = model.z.copy(), model.n.copy()
        for row in space.keep(means, f"pass-{k}").toLocalIterator():
            own = slice(row["slab"] * SLAB, min((row["slab"] + 1) * SLAB, len(z)))
            z[own] += np.frombuffer(row["dz"])[: own.stop - own.start]
            n[own] += np.frombuffer(row["dn"])[: own.stop - own.start]
        model = Ftrl(*options, z=z, n=n)
        state.destroy()
        space.drop(f"pass-{k}")
    space.drop("features")
    return model


def score_rows(docs: DataFrame, score: Callable[[], Callable], extra: str = "") -> DataFrame:
    """(doc_id, score, *extra) of each row; ``score()`` is called once a task and gives a function of texts."""
    batches_of(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = score()
        for piece in in_pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *of(piece.column("text").to_pylist())], names=["doc_id", *names])

    schema = "score double" + extra
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.mapInArrow(run, f"doc_id long, {schema}")


def keep_rows(docs: DataFrame, score: Callable[[], Callable], at_least: float) -> DataFrame:
    """The rows of ``docs`` whose text scores at least so much, with all their columns; texts don't leave their task."""
    batches_of(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = score()
        for piece in in_pieces(batches):
            points = of(piece.column("text").cast(pa.binary()).to_pylist())[0]
            yield piece.filter(pa.array(np.asarray(points) >= at_least))

    return docs.mapInArrow(run, docs.schema)
