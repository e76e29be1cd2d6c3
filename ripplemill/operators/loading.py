"""Scans of topics to fixed end offsets, loss audits, idempotent loads, guarded labels, and batches that quarantine bad rows."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of a label file that may be read again; the others determine the class.
IDENTITY = "root_node_id string, label string, subtype string, topic_id string, t0 timestamp"
TRIES, PAUSE_S = 3, 0.05


# --- topics


def end_offsets(log: DataFrame) -> DataFrame:
    """(topic, partition, end): where each partition of ``log`` (topic, partition, offset, ..) ends now, markers of transactions included."""
    return log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end"))


def scan_to(log: DataFrame, ends: DataFrame, since: float = 0.0) -> DataFrame:
    """The messages of ``log`` (.., timestamp in ms, value) below fixed ends and not older than ``since``.

    Messages that come later, in partitions old or new, are not in it, however often it is read.
    Markers take offsets of their own and have no value; they are never messages.
    """
    rows = log.join(ends, ["topic", "partition"]).where((F.col("offset") < F.col("end")) & (F.col("timestamp") >= since * 1000) & F.col("value").isNotNull())
    return rows.drop("end")


def loss_audit(messages: DataFrame, nodes: DataFrame, dead: DataFrame, content_platforms: list[str]) -> DataFrame:
    """One row: messages, records, copies, written, missing, dead. ``messages`` (platform, id), ``nodes`` (id, platform, placeholder).

    A record is missing if no node has its id and platform, or only a placeholder.
    """
    records = messages.where(F.col("platform").isin(content_platforms)).groupBy(F.concat_ws(":", "platform", "id").alias("id"), "platform").agg(F.count("*").alias("copies"))
    known = nodes.groupBy("id", "platform").agg(F.min("placeholder").alias("placeholder"))
    j = records.join(known, ["id", "platform"], "left").withColumn("there", F.coalesce(~F.col("placeholder"), F.lit(False)))
    counted = j.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("copies"), F.count_if("there").alias("written"), F.count_if(~F.col("there")).alias("missing"))
    return messages.agg(F.count("*").alias("messages")).crossJoin(counted).crossJoin(dead.agg(F.count("*").alias("dead")))


# --- loads


def to_append(rows: DataFrame, key: list[str], order: str, existing: DataFrame | None = None, last: bool = False) -> DataFrame:
    """``rows`` once a key, the first by ``order`` (or the ``last``), without the keys that ``existing`` has: a second load adds nothing. Null keys are keys."""
    by = F.desc(order) if last else F.asc(order)
    once = rows.withColumn("k_", F.row_number().over(Window.partitionBy(*key).orderBy(by))).where("k_ = 1").drop("k_")
    if existing is None:
        return once
    old = existing.select(*[F.col(c).alias(f"{c}_old") for c in key]).distinct()
    return once.join(old, [F.col(c).eqNullSafe(F.col(f"{c}_old")) for c in key], "left_anti")


def bulk_append(rows: DataFrame, path: str, key: list[str], order: str, last: bool = False) -> int:
    """Append what is new of ``rows`` to the table at ``path``; how many rows that were."""
    existing = rows.sparkSession.read.schema(rows.schema).parquet(path) if _exists(rows.sparkSession, path) else None
    name = uuid.uuid4().hex
    staged = f"{path.rstrip('/')}-{name}"
    to_append(rows, key, order, existing, last).write.parquet(staged)  # before anything is added to what it is compared with
    new = rows.sparkSession.read.schema(rows.schema).parquet(staged)
    n = new.count()
    new.write.mode("append").parquet(path)
    _delete(rows.sparkSession, staged)
    return n


def labels_from(spark: SparkSession, path: str) -> DataFrame:
    """Who is what, from a CSV of labels with headers: identity columns only, by name, whatever else the file holds."""
    wanted = [c.split()[0] for c in IDENTITY.split(", ")]
    return spark.read.option("header", True).csv(path).select(*wanted).withColumn("t0", F.try_to_timestamp("t0"))


def write_labels(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def event_time(raw: Column, arrival: Column) -> Column:
    """A timestamp from text; what is missing or can't be read has the time of its arrival."""
    return F.coalesce(F.try_to_timestamp(raw), arrival)


def to_embed(nodes: DataFrame, embeddings: DataFrame, model: str, version: str) -> DataFrame:
    """(node_id, platform, label, model_name, model_version) of the topics that this version of a model has no vector for."""
    wanted = nodes.where("type IN ('named_entity', 'repo')").select(F.col("id").alias("node_id"), "platform", "label", F.lit(model).alias("model_name"), F.lit(version).alias("model_version")).dropDuplicates(["node_id", "platform"])
    return wanted.join(embeddings.select("node_id", "platform", "model_name", "model_version"), ["node_id", "platform", "model_name", "model_version"], "left_anti").select("node_id", "platform", "label", "model_name", "model_version")


# --- batches


def quarantine(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``error``): a row is bad by the first check that is not true of it."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]) if checks else F.lit(None).cast("string")
    judged = rows.withColumn("error", error)
    return judged.where("error IS NULL").drop("error"), judged.where("error IS NOT NULL")


def _files(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    there, files = _files(spark, path)
    return files.exists(there)


def _delete(spark: SparkSession, path: str) -> None:
    there, files = _files(spark, path)
    files.delete(there, True)


def write_whole(parts: dict[str, DataFrame], path: str, number: int, tries: int = TRIES, write: Callable[[DataFrame, str], None] | None = None) -> int:
    """All tables of a batch under its number, or none: they are staged, then moved into place one by one, the marker last. How many tries it took.

    A batch without its marker does not count (``batches``), so one that stopped half way is
    written again whole. Fails after the last try.
    """
    spark = next(iter(parts.values())).sparkSession
    write = write or (lambda df, to: df.write.parquet(to))
    for n in range(1, tries + 1):
        staged = f"{path}/_staged-{number}-{uuid.uuid4().hex[:8]}"
        try:
            for name, df in parts.items():
                write(df, f"{staged}/{name}")
            for name in parts:
                target = f"{path}/{name}/batch={number}"
                _delete(spark, target)
                _files(spark, f"{path}/{name}")[1].mkdirs(_files(spark, f"{path}/{name}")[0])
                source, files = _files(spark, f"{staged}/{name}")
                if not files.rename(source, _files(spark, target)[0]):
                    raise OSError(f"cannot move {staged}/{name}")
            marker, files = _files(spark, f"{path}/_done/batch={number}")
            files.mkdirs(marker)
            return n
        except Exception:
            if n == tries:
                raise
            time.sleep(PAUSE_S * n)
        finally:
            _delete(spark, staged)
    raise AssertionError("unreachable")


def batches(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """What whole batches have written to one table, with ``batch``; null if there is none."""
    there, files = _files(spark, f"{path}/_done")
    done = [s.getPath().getName() for s in files.listStatus(there)] if files.exists(there) else []
    found = [f"{path}/{name}/{d}" for d in done if _exists(spark, f"{path}/{name}/{d}")]
    return spark.read.option("basePath", f"{path}/{name}").parquet(*found) if found else None


def write_batch(items: DataFrame, path: str, number: int, checks: dict[str, Column], tries: int = TRIES, write: Callable[[DataFrame, str], None] | None = None) -> int:
    """Good rows to ``rows``, bad ones with their errors to ``dead``, in one batch."""
    good, bad = quarantine(items, checks)
    return write_whole({"rows": good, "dead": bad}, path, number, tries, write)
