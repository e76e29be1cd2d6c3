"""The tables the engine reads: a propagation graph over an event log.

Twenty consecutive events are one cascade whose shape is a star, a chain or a binary tree
by turns; authors are users, topics are event types and the ``k`` of the properties.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLATFORMS = ["bluesky", "mastodon", "hn", "github"]
CASCADE = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 with fractions, of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1_000_000


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: its content, author, topics, platform, cascade and parent."""
    e = table(spark, sf_dir, "events")
    b, pos = F.floor(F.col("event_id") / CASCADE), F.col("event_id") % CASCADE
    parent = F.when(b % 3 == 0, b * CASCADE).when(b % 3 == 1, F.col("event_id") - 1).otherwise(b * CASCADE + F.floor((pos - 1) / 2))
    return e.select(
        "event_id", "ts", epoch(F.col("ts")).alias("t"), "user_id", "event_type", "value",
        b.alias("cascade"), pos.alias("pos"),
        F.concat(F.lit("ev:"), F.col("event_id")).alias("content_id"),
        F.concat(F.lit("user:"), F.col("user_id")).alias("author_id"),
        F.concat(F.lit("entity:org:"), F.col("event_type")).alias("topic"),
        F.concat(F.lit("entity:product:k"), F.get_json_object("props", "$.k")).alias("topic2"),
        F.element_at(F.array(*map(F.lit, PLATFORMS)), (F.col("user_id") % 4 + 1).cast("int")).alias("platform"),
        F.when(pos > 0, F.concat(F.lit("ev:"), parent)).alias("parent_id"),
        F.concat(F.lit("ev:"), b * CASCADE).alias("root_id"),
    )


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    posts: DataFrame


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    p = posts(spark, sf_dir)

    def edge(source: str, target: str, kind: str) -> DataFrame:
        return p.where(F.col(source).isNotNull()).select("event_id", F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.lit(kind).alias("edge_type"), "platform", "ts", "t")

    edges = edge("parent_id", "content_id", "reshare").union(edge("author_id", "content_id", "authored")).union(edge("content_id", "topic", "mentions")).union(edge("content_id", "topic2", "mentions"))

    def node(column: str, kind: str) -> DataFrame:
        return p.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("id"), "platform").agg(F.lit(kind).alias("type"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))

    nodes = node("content_id", "content").union(node("author_id", "author")).union(node("topic", "named_entity")).union(node("topic2", "named_entity"))
    return Graph(nodes.withColumn("label", F.regexp_extract("id", "[^:]+$", 0)), edges, p)
