"""How far streams are behind: a table of their progress, and reports over stretches of it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SAMPLE = "query string, batch long, t double, produced long, consumed long, lag long, behind_s double, rows long, produce_rate double, consume_rate double"


def _total(offset) -> int | None:
    """Sum of the positions in a source's offset: a number, or numbers by topic and partition; null where it is neither."""
    try:
        x = json.loads(offset) if isinstance(offset, str) else offset
    except ValueError:
        return None
    if isinstance(x, bool) or x is None:
        return None
    if isinstance(x, (int, float)):
        return int(x)
    if isinstance(x, dict):
        parts = [_total(v) for v in x.values()]
        return sum(p for p in parts if p is not None) if any(p is not None for p in parts) else None
    return None


class Monitor(StreamingQueryListener):
    """Appends a row of ``SAMPLE`` to the table at ``path`` for each progress of each query.

    ``behind_s`` is the age of the oldest event that is not done: of the watermark where there is
    one, else of the trigger; 0 when nothing waits.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.spark.createDataFrame([sample(json.loads(p.json))], SAMPLE).write.mode("append").parquet(self.path)


def sample(p: dict) -> tuple:
    """One row of ``SAMPLE`` from a progress report."""
    from datetime import datetime

    at = lambda s: datetime.fromisoformat(s.replace("Z", "+00:00")).timestamp()
    t = at(p["timestamp"])
    ends = [(_total(s.get("endOffset")), _total(s.get("latestOffset"))) for s in p.get("sources", [])]
    consumed = sum(e for e, _ in ends if e is not None)
    produced = sum(max(n if n is not None else e or 0, e or 0) for e, n in ends)
    lag = produced - consumed
    mark = (p.get("eventTime") or {}).get("watermark")
    behind = max(0.0, t - at(mark)) if lag and mark and not mark.startswith("1970") else float(lag and (p.get("durationMs") or {}).get("triggerExecution", 0) / 1000)
    rate = lambda k: float(p.get(k) or 0.0)
    return (p.get("name") or p["id"], int(p["batchId"]), t, produced, consumed, lag, round(behind, 1), int(p.get("numInputRows", 0)), rate("inputRowsPerSecond"), rate("processedRowsPerSecond"))


def offset_lag(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """(topic, partition, lag) between ``ends`` (topic, partition, end) and what a consumer has ``committed`` (topic, partition, offset); what it never read counts whole."""
    j = ends.join(committed, ["topic", "partition"], "left")
    return j.select("topic", "partition", F.greatest(F.lit(0), F.col("end") - F.coalesce("offset", F.lit(0))).alias("lag"))


def oldest_waiting(log: DataFrame, committed: DataFrame, now: float) -> DataFrame:
    """One row, behind_s: the age of the oldest message of ``log`` (topic, partition, offset, timestamp in ms) at or after what is committed; 0 if none waits."""
    first = log.join(committed.withColumnRenamed("offset", "next_"), ["topic", "partition"], "left").where(F.col("offset") >= F.coalesce("next_", F.lit(0)))
    first = first.groupBy("topic", "partition").agg(F.min_by("timestamp", "offset").alias("timestamp"))
    return first.agg(F.coalesce(F.round(F.lit(now) - F.min("timestamp") / 1000, 1), F.lit(0.0)).alias("behind_s"))


def rates(samples: DataFrame) -> DataFrame:
    """Running counts (run, t, produced, consumed, ..) with the rates since the sample before; a run's first has none."""
    w = Window.partitionBy("run").orderBy("t")
    dt = F.col("t") - F.lag("t").over(w)
    return samples.withColumns({f"{k}_rate": F.round((F.col(c) - F.lag(c).over(w)) / dt, 1) for k, c in (("produce", "produced"), ("consume", "consumed"))})


def phases(samples: DataFrame) -> DataFrame:
    """(run, phase, produce, consume, max_lag, max_behind, end_lag) of rated samples that have a ``phase``."""
    rows = samples.where("consume_rate IS NOT NULL AND phase IS NOT NULL")
    return rows.groupBy("run", "phase").agg(F.avg("produce_rate").alias("produce"), F.avg("consume_rate").alias("consume"), F.max("lag").alias("max_lag"), F.max("behind_s").alias("max_behind"), F.max_by("lag", "t").alias("end_lag"))


def alert_rate(samples: DataFrame, skip_s: float = 300.0) -> DataFrame:
    """(run, per_minute): alerts a minute from a running count, after the first ``skip_s``."""
    start = samples.groupBy("run").agg(F.min("t").alias("start"))
    rows = samples.join(start, "run").where((F.col("t") >= F.col("start") + skip_s) & F.col("anomalies").isNotNull())
    a = rows.groupBy("run").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("anomalies", "t").alias("n0"), F.max_by("anomalies", "t").alias("n1"))
    return a.where("t1 > t0").select("run", ((F.col("n1") - F.col("n0")) / ((F.col("t1") - F.col("t0")) / 60)).alias("per_minute"))
