"""Structured Streaming: raw records into merged tables.

``ingest`` writes edges, nodes, mentions and dead letters. A bounded seen-set in front of it
refuses records that come again, and edges are compared with what is stored of the same days
only, so a batch costs the same however much has been stored. ``deduplicated``, ``hopping_velocity`` and ``scored`` are operators
on streams of their own (``scored`` over the mentions that ``ingest`` stores, for one).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import decode, extract, merge_edges, merge_nodes
from ..operators.velocity import THRESHOLDS, Baseline
from .seen import MOST, SHARDS, first_seen, rocks


def deduplicated(records: DataFrame, ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """One record for each (platform, id); what is remembered is bounded by the watermark."""
    return records.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark(["platform", "id"])


def hopping_velocity(mentions: DataFrame, window: str = "1 hour", hop: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of each entity in windows of ``window`` that begin every ``hop``."""
    m = mentions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return m.groupBy(F.window("ts", window, hop), "entity_id").agg(F.count("*").alias("n_events")).select("entity_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_events")


def scored(mentions: DataFrame, window_s: float = 3600.0, warm_s: float = 0.0, cusum: float = THRESHOLDS["cusum"]) -> DataFrame:
    """Velocity and the sequential baselines of each mention (entity_id, t, arrival) of a stream, in order of arrival.

    An entity's state is its times within the window, which reaches back from the newest, and
    its baseline. Mentions in the first ``warm_s`` of an entity count, but are neither judged
    nor history. The state is checkpointed, so a restarted stream goes on warm.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, first, baseline = pickle.loads(state.get[0]) if state.exists else ([], None, Baseline(cusum))
        rows = []
        for r in pd.concat(list(batches)).sort_values("arrival").itertuples():
            times.append(r.t)
            newest = max(times)
            times = [x for x in times if x >= newest - window_s]
            first = r.t if first is None else min(first, r.t)
            n, v = len(times), round(len(times) / (window_s / 60), 4)
            if newest - first >= warm_s:
                rows.append((key[0], r.arrival, n, v, *baseline.step(v, n)))
        state.update((pickle.dumps((times, first, baseline)),))
        yield pd.DataFrame(rows, columns=["entity_id", "arrival", "n_events", "velocity", "ewma", "poisson", "negbin", "cusum", "fired"])

    schema = "entity_id string, arrival long, n_events long, velocity double, ewma double, poisson double, negbin double, cusum double, fired boolean"
    return mentions.select("entity_id", "t", "arrival").groupBy("entity_id").applyInPandasWithState(step, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def _stored(spark: SparkSession, path: str, number: int, schema: str, days: list[str]) -> DataFrame:
    """What earlier batches have written for these days; a replay doesn't see its own rows, other days are not read."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(there):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(f"{schema}, batch long, day string").parquet(path)
    return stored.where((F.col("batch") < number) & F.col("day").isin(days)).drop("batch", "day")


def writer(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over decoded records: what is new in a batch, under its own number, so that a replay overwrites itself.

    Edges that an earlier batch has stored are left out. Nodes are stored as they arrive;
    ``nodes`` merges them.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.cache()
        found = extract(batch.where("error IS NULL").drop("error", "value")).cache()
        edges = found.select(F.explode("edges").alias("e"), F.col("partition").alias("part"), F.col("offset").alias("arrival")).select("e.*", F.struct("part", "arrival").alias("arrival"))
        edges = edges.withColumn("day", F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("none")))
        days = [r["day"] for r in edges.select("day").distinct().collect()]
        old = _stored(spark, f"{path}/edges", number, "source_id string, target_id string, platform string, ts timestamp", days)
        merge_edges(edges, old).withColumn("arrival", F.col("arrival.arrival")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/edges/batch={number}")
        seen = F.coalesce(F.try_to_timestamp("created_at"), F.try_to_timestamp("ingested_at"))
        nodes = found.select(F.explode("nodes").alias("n"), F.col("partition").alias("part"), F.col("offset").alias("arrival"), seen.alias("seen")).select("n.*", "part", "arrival", "seen")
        nodes.write.mode("overwrite").parquet(f"{path}/nodes/batch={number}")
        nodes.where("type IN ('named_entity', 'repo')").select(F.col("id").alias("entity_id"), "platform", "arrival", F.col("seen").alias("ts")).write.mode("overwrite").parquet(f"{path}/mentions/batch={number}")
        batch.where("error IS NOT NULL").select("topic", "partition", "offset", "error", "value").write.mode("overwrite").parquet(f"{path}/dead/batch={number}")
        found.unpersist()
        batch.unpersist()

    return write


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """The stored arrivals of nodes, merged over all batches in their order."""
    n = spark.read.parquet(f"{path}/nodes")
    return merge_nodes(n.withColumn("arrival", F.struct("batch", "part", "arrival")))


def ingest(raw: DataFrame, path: str, checkpoint: str, most: int = MOST, shards: int = SHARDS, **trigger):
    """Starts the query over ``raw`` (topic, partition, offset, value); its state and its files go on where they stopped."""
    with rocks(raw.sparkSession):
        fresh = first_seen(decode(raw), most, shards)
        return fresh.writeStream.foreachBatch(writer(path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
