"""Trending topics: two windows compared, with sparkline, first arrivals and a stats card."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import short_code

KINDS = ["named_entity", "repo", "content"]
SLOTS = 12


def trending(nodes: DataFrame, edges: DataFrame, as_of, minutes: float, limit: int = 50) -> DataFrame:
    """Candidates by mentions in the last ``minutes``, with the change against the window before."""
    w = minutes * 60
    recent = edges.where((F.col("t") >= as_of - w) & (F.col("t") <= as_of))
    prev = edges.where((F.col("t") >= as_of - 2 * w) & (F.col("t") < as_of - w))
    # only nodes that are mentioned now can trend
    n = nodes.where(F.col("type").isin(KINDS)).join(recent.select(F.col("target_id").alias("id")).distinct(), "id", "left_semi")
    curr = n.select("id", F.col("type").alias("kind"), F.col("platform").alias("own")).groupBy("id").agg(F.min("kind").alias("kind"), F.min("own").alias("own"), F.count("*").alias("platform_rows"))
    c = recent.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("curr"), F.concat_ws(",", F.sort_array(F.collect_set("platform"))).alias("platforms"), F.min("t").alias("first"), F.max("t").alias("last"))
    p = prev.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("before"))
    # nodes are keyed by platform too, and the earlier count is taken once for each of their rows
    j = c.join(curr, "id").join(p, "id", "left").withColumn("prev", F.coalesce("before", F.lit(0)) * F.col("platform_rows"))
    delta = F.when(F.col("prev") > 0, F.bround((F.col("curr") - F.col("prev")) / F.col("prev") * 100)).when(F.col("curr") > 0, 100).otherwise(0).cast("int")
    out = j.withColumn("delta", delta).select(
        "id", "kind", "curr", "prev", F.round(F.col("curr") / minutes, 2).alias("velocity"), "delta",
        F.when(F.col("delta") > 10, "rising").when(F.col("delta") < -10, "cooling").otherwise("plateau").alias("trajectory"), "platforms",
    )
    return out.orderBy(F.desc("curr"), "id").limit(limit)


def sparkline(edges: DataFrame, ids: DataFrame, as_of, minutes: float) -> DataFrame:
    """Twelve slots a topic, scaled to the largest; the slot beyond the last overwrites it."""
    w = minutes * 60
    e = edges.where((F.col("t") >= as_of - w) & (F.col("t") <= as_of)).join(F.broadcast(ids), edges["target_id"] == ids["id"], "left_semi")
    slot = F.least(F.floor((F.col("t") - (as_of - w)) / (w / SLOTS)) + 1, F.lit(SLOTS))
    s = e.groupBy("target_id", slot.alias("slot")).agg(F.count("*").alias("n"))
    s = s.groupBy("target_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"), F.max("n").alias("most"))
    line = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(SLOTS).cast("long")), lambda k: F.round(F.coalesce(F.try_element_at("m", k), F.lit(0)) / F.col("most"), 3))
    return s.select(F.col("target_id").alias("id"), F.concat_ws(",", F.transform(line, lambda x: x.cast("decimal(6,3)").cast("string"))).alias("sparkline"))


def first_arrivals(edges: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Minutes since a topic first came to each platform, oldest first."""
    e = edges.join(F.broadcast(ids), edges["target_id"] == ids["id"], "left_semi").groupBy("target_id", "platform").agg(F.min("t").alias("first"))
    return e.select(F.col("target_id").alias("id"), "platform", F.floor((as_of - F.col("first")) / 60).cast("long").alias("minutes_ago"))


def stats_card(rows: DataFrame) -> DataFrame:
    ranked = rows.withColumn("r", F.row_number().over(Window.orderBy(F.desc("velocity"), "id")))
    return ranked.agg(F.count("*").alias("topics"), F.sum("curr").alias("mentions"), F.max(F.when(F.col("r") == 1, F.col("id"))).alias("fastest"), F.count_if(F.col("platforms").contains(",")).alias("cross_platform"), F.count_if(F.col("trajectory") == "rising").alias("rising"))


def by_spread(rows: DataFrame) -> DataFrame:
    """Trending rows with ``place``: more platforms first, else as they were."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.size(F.split("platforms", ","))), F.desc("curr"), "id")))


def topics(rows: DataFrame, alarms: DataFrame, as_of, recent_s: float) -> DataFrame:
    """Trending rows with short platform codes, and ``breaking`` where an alarm (id, t) is recent."""
    loud = alarms.where(F.col("t") >= as_of - recent_s).select("id").distinct().withColumn("breaking", F.lit(True))
    short = F.array_sort(F.array_distinct(F.transform(F.split("platforms", ","), short_code)))
    return rows.join(loud, "id", "left").fillna(False, ["breaking"]).withColumn("short", F.concat_ws(",", short))


def steps(arrivals: DataFrame, rows: DataFrame) -> DataFrame:
    """``arrivals`` by topic; a topic without any has its first platform, just now."""
    none = rows.join(arrivals.select("id").distinct(), "id", "left_anti").select("id", F.split("platforms", ",")[0].alias("platform"), F.lit(0).cast("long").alias("minutes_ago"))
    return arrivals.select("id", "platform", "minutes_ago").union(none)


def totals(rows: DataFrame, edges: DataFrame, as_of, minutes: float) -> DataFrame:
    """The card above the topics: how many, how many more than in the window before (at least 0), and what stands out. No topics: zeros."""
    w = minutes * 60
    before = edges.where((F.col("t") >= as_of - 2 * w) & (F.col("t") < as_of - w)).agg(F.countDistinct("target_id").alias("before"))
    card = rows.agg(F.count("*").alias("topics"), F.coalesce(F.max("velocity"), F.lit(0.0)).alias("fastest"), F.count_if(F.col("platforms").contains(",")).alias("cross_platform"), F.count_if("breaking").alias("breaking"))
    return card.crossJoin(before).select("topics", F.greatest(F.lit(0), F.col("topics") - F.col("before")).alias("more"), "fastest", "cross_platform", "breaking")
