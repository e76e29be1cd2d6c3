"""Velocity at any time asked for, and warm-up by source partition with restarts.

A topic's window holds what has been recorded and not evicted. Recording a mention evicts what
is older than a window before the newest mention; asking for the velocity at a time evicts what
is older than a window before that time, but records nothing. So the floor of a topic, the
oldest time it still holds, rises with each step and never falls, and each mention is evicted at
one step: the first whose floor is above it. A window's count is then the number recorded less
the number evicted so far, two running sums; no mention meets a question in a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import SLICE, running


def velocity_at(mentions: DataFrame, asked: DataFrame | None = None, window_s: float = 3600.0, slice_rows: int = SLICE) -> DataFrame:
    """(entity_id, arrival, asked, n_events, velocity) of each step, in order of arrival.

    ``mentions`` (entity_id, t, arrival): recorded; ``asked`` (entity_id, at, arrival): questions,
    after the mentions of the same arrival. Arrivals are whole numbers, in an entity each mention's
    its own. A mention that comes later than a whole window is recorded and evicted at once.
    Questions about entities without mentions count 0.
    """
    steps = mentions.select("entity_id", "arrival", F.col("t").alias("v"), F.lit(0).alias("asked"))
    if asked is not None:
        steps = steps.union(asked.select("entity_id", "arrival", F.col("at").alias("v"), F.lit(1)))
    steps = steps.withColumn("step", F.col("arrival") * 2 + F.col("asked"))
    floors = running(steps, ["entity_id"], "step", F.col("v"), F.max, "newest", 2 * slice_rows).withColumn("floor", F.col("newest") - window_s)
    gone = evictions(floors, window_s)
    # a question may be asked twice at one step, a mention counts once
    recorded = F.when(F.col("asked") == 0, 1).otherwise(0)
    changes = floors.select("entity_id", "step", "arrival", "asked", F.lit(1).alias("is_step"), recorded.alias("change")).union(gone.select("entity_id", "step", F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(0), F.lit(-1)))
    counted = running(changes, ["entity_id"], "step", F.col("change"), F.sum, "n_events", 2 * slice_rows).where("is_step = 1")
    return counted.select("entity_id", "arrival", (F.col("asked") == 1).alias("asked"), "n_events", F.round(F.col("n_events") / F.lit(window_s / 60), 4).alias("velocity"))


def evictions(floors: DataFrame, window_s: float) -> DataFrame:
    """(entity_id, step) at which each mention of ``floors`` (entity_id, step, asked, v, floor) is evicted; none for those that stay.

    The first floor above a mention is in the same stretch of time as the mention or the first of
    a later stretch that has one, for floors rise with the steps.
    """
    stretch = lambda t: F.floor(t / (window_s / 60))
    raised = floors.select("entity_id", F.col("floor").alias("at"), F.col("step").alias("by"), F.lit(None).cast("long").alias("step"))
    recorded = floors.where("asked = 0").select("entity_id", F.col("v").alias("at"), F.lit(None).cast("long").alias("by"), "step")
    # downwards; of equal times the mentions first, which a floor as high as they are leaves
    down = Window.partitionBy("entity_id", "stretch").orderBy(F.desc("at"), F.col("by").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = raised.union(recorded).withColumn("stretch", stretch(F.col("at"))).withColumn("first", F.min("by").over(down)).where("step IS NOT NULL")
    later = Window.partitionBy("entity_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    every = raised.union(recorded).groupBy("entity_id", stretch(F.col("at")).alias("stretch")).agg(F.min("by").alias("by")).withColumn("next", F.min("by").over(later))
    found = near.join(every.select("entity_id", "stretch", "next"), ["entity_id", "stretch"], "left").withColumn("by", F.least("first", "next"))
    return found.where("by IS NOT NULL").select("entity_id", F.greatest("by", "step").alias("step"))


def warm_by_partition(mentions: DataFrame, resets: DataFrame, window_s: float = 3600.0, slice_rows: int = SLICE) -> DataFrame:
    """``mentions`` (partition_id, t, arrival, ..) with since and warm.

    A partition's clock starts with the first mention after it was assigned (again): a row of
    ``resets`` (partition_id, arrival) restarts it for the mentions from that arrival on. Mentions
    are warm when a whole window has passed since; colder ones count but are neither judged nor
    history.
    """
    order = mentions.select(*mentions.columns, F.lit(0).alias("reset_"))
    marks = resets.select(*[F.col(c) if c in ("partition_id", "arrival") else F.lit(None).cast(mentions.schema[c].dataType).alias(c) for c in mentions.columns], F.lit(1).alias("reset_"))
    terms = running(order.union(marks), ["partition_id"], "arrival", F.col("reset_"), F.sum, "term_", slice_rows).where("reset_ = 0")
    since = terms.groupBy("partition_id", "term_").agg(F.min_by("t", "arrival").alias("since"))
    joined = terms.join(since.select(F.col("partition_id").alias("p_"), F.col("term_").alias("k_"), "since"), F.col("partition_id").eqNullSafe(F.col("p_")) & (F.col("term_") == F.col("k_")))
    return joined.select(*mentions.columns, "since", (F.col("t") - F.col("since") >= window_s).alias("warm"))


def judged(mentions: DataFrame, resets: DataFrame, window_s: float = 3600.0) -> DataFrame:
    """The warm samples (entity_id, arrival, t, n_events, velocity): counted from all mentions, kept where their partition is warm."""
    counts = velocity_at(mentions, None, window_s).select("entity_id", "arrival", "n_events", "velocity")
    warm = warm_by_partition(mentions, resets, window_s).where("warm").select("entity_id", "arrival", "t")
    return warm.join(counts, ["entity_id", "arrival"])
