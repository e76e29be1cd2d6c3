"""Queries over the event log as a stream would see it: velocity as of any time, warm-up by partition, seen-sets, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof as O
from ..operators import velocity as A
from ..operators.working import written
from ..sources.tables import graph, posts
from .cases import query
from .queries import _r

#: Mentions that come thirty events late, each with an arrival of its own.
LATE = "l AS (SELECT entity_id, platform, t, ((CASE WHEN arrival % 50 = 0 THEN arrival + 30 ELSE arrival END) * 2 + (arrival % 50 = 0)::INT)::BIGINT AS arrival FROM m)"
#: Questions about the topic of every third event, some of them about times to come, some about the past.
ASKED = "a AS (SELECT topic AS entity_id, t + (event_id % 7 - 2) * 900 AS asked_at, event_id * 2 AS arrival FROM p WHERE event_id % 3 = 0)"
#: Steps in order of arrival, a question after the mention of its arrival, with the floor that each leaves.
STEPS = "st AS (SELECT *, max(v) OVER (PARTITION BY entity_id ORDER BY arrival, asked) - 3600 AS floor FROM (SELECT entity_id, arrival, t AS v, 0 AS asked FROM l UNION ALL SELECT entity_id, arrival, asked_at, 1 FROM a))"
#: Partitions of the mentions, and restarts of their clocks.
TERMS = "w0 AS (SELECT m.*, arrival % 3 AS partition_id FROM m), rs AS (SELECT event_id % 3 AS partition_id, event_id AS arrival FROM p WHERE event_id % 1499 = 700), tm AS (SELECT w0.*, (SELECT count(*) FROM rs WHERE rs.partition_id = w0.partition_id AND rs.arrival <= w0.arrival) AS term FROM w0), sc AS (SELECT partition_id, term, arg_min(t, arrival) AS since FROM tm GROUP BY 1, 2), wm AS (SELECT tm.*, since, t - since >= {window} AS warm FROM tm JOIN sc USING (partition_id, term))"


def _late(spark: SparkSession, sf: str) -> DataFrame:
    m = A.mentions(graph(spark, sf).edges)
    late = (F.col("arrival") % 50 == 0).cast("int")
    return m.withColumn("arrival", (F.col("arrival") + 30 * late) * 2 + late)


@query(
    f", {LATE}, {ASKED}, {STEPS} SELECT q.entity_id, q.arrival, count(e.t) AS n_events, round(count(e.t) / 60.0::DOUBLE, 4) AS velocity FROM (SELECT entity_id, arrival, min(floor) AS floor FROM st WHERE asked = 1 GROUP BY 1, 2) q "
    "LEFT JOIN l e ON e.entity_id = q.entity_id AND e.arrival <= q.arrival AND e.t >= q.floor GROUP BY 1, 2"
)
def t2_velocity_as_of(spark, sf):
    """The velocity of topics at times asked for, between late mentions: what a question evicts stays away, what it asks about is not recorded."""
    asked = posts(spark, sf).where("event_id % 3 = 0").select(F.col("topic").alias("entity_id"), (F.col("t") + (F.col("event_id") % 7 - 2) * 900).alias("at"), (F.col("event_id") * 2).alias("arrival"))
    return O.velocity_at(_late(spark, sf), asked).where("asked").select("entity_id", "arrival", "n_events", "velocity").transform(_r)


@query(f", {LATE}, {ASKED}, {STEPS} SELECT q.entity_id, q.arrival, count(*) AS n_events FROM st q JOIN l e ON e.entity_id = q.entity_id AND e.arrival <= q.arrival AND e.t >= q.floor WHERE q.asked = 0 GROUP BY 1, 2")
def t2_recorded_between_questions(spark, sf):
    """The count that each late mention is recorded with, questions in between."""
    asked = posts(spark, sf).where("event_id % 3 = 0").select(F.col("topic").alias("entity_id"), (F.col("t") + (F.col("event_id") % 7 - 2) * 900).alias("at"), (F.col("event_id") * 2).alias("arrival"))
    # a mention that its own step evicts counts nothing, and SQL lists those that count
    return O.velocity_at(_late(spark, sf), asked).where("NOT asked AND n_events > 0").select("entity_id", "arrival", "n_events")


def _dealt(spark, sf):
    m = A.mentions(graph(spark, sf).edges).withColumn("partition_id", F.col("arrival") % 3)
    resets = posts(spark, sf).where("event_id % 1499 = 700").select((F.col("event_id") % 3).alias("partition_id"), F.col("event_id").alias("arrival"))
    return m, resets


@query(f", {TERMS.format(window=86400)} SELECT entity_id, arrival, round(since, 6) AS since, warm FROM wm")
def t4_partition_warm_up(spark, sf):
    """Each mention with the start of its partition's clock, restarted by assignments, and whether a day has passed since."""
    return O.warm_by_partition(*_dealt(spark, sf), 86400.0).select("entity_id", "arrival", "since", "warm").transform(_r)


@query(
    f", {TERMS.format(window=3600)}, j AS (SELECT v.entity_id, v.arrival, v.velocity FROM v JOIN wm USING (entity_id, arrival) WHERE warm) "
    "SELECT entity_id, arrival, CASE WHEN list_stddev_pop(h) > 1e-12 THEN round((velocity - list_avg(h)) / list_stddev_pop(h), 4) END AS zscore "
    "FROM (SELECT *, list(velocity) OVER (PARTITION BY entity_id ORDER BY arrival ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS h FROM j) WHERE len(h) >= 5"
)
def t4_judged_when_warm(spark, sf):
    """z-scores of warm samples against earlier warm ones: cold mentions count, but are neither judged nor history, and history outlives a restart."""
    samples = written(O.judged(*_dealt(spark, sf)), "judged")
    return A.zscores(samples).select("entity_id", "arrival", "zscore").transform(_r)
