"""Cascades as graphs of posts: a row of eight inputs a post, and messages passed along reshares.

Everything is one row a post or an edge; a cascade is never gathered, so one of a third of all
posts is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import prior_cascades, with_parent, tree_roots
from .working import written

# The inputs of a post, in order, and what depths and logged times are divided by.
INPUTS = ["is_root", "depth", "log_delay", "log_since_root", "hop", "log_out_degree", "log_prior_author", "author_repeat"]
SHARE = 5.0
#: Seconds of a cascade that are numbered in one go.
STRETCH_S = 60


def post_inputs(tree: DataFrame, authors: DataFrame) -> DataFrame:
    """(root_id, post_id, place, t, *INPUTS): one row a post of each cascade, the root first, then by time.

    A post that several edges of a cascade lead to counts with the first of them. ``place`` counts
    from 0; posts of unknown authors have no prior cascades and repeat nobody.
    """
    tree = tree.groupBy("root_id", "target_id").agg(F.min(F.struct("t", "source_id", "platform", "depth")).alias("e")).select("root_id", "e.source_id", "target_id", "e.t", "e.platform", "e.depth")
    root = tree_roots(tree, authors)
    edges = with_parent(tree, root).join(root.select("root_id", "t0"), "root_id")
    log = lambda x: F.log1p(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
    posts = edges.select(
        "root_id", F.col("target_id").alias("post_id"), "t", F.lit(0.0).alias("is_root"), (F.col("depth") / SHARE).alias("depth"), (log(F.col("t") - F.col("pt")) / SHARE).alias("log_delay"),
        (log(F.col("t") - F.col("t0")) / SHARE).alias("log_since_root"), (F.col("pp").isNull() | (F.col("pp") != F.col("platform"))).cast("double").alias("hop"),
    )
    zero = lambda c: F.lit(0.0).alias(c)
    posts = posts.union(root.select("root_id", "root_id", F.col("t0"), F.lit(1.0), zero("depth"), zero("log_delay"), zero("log_since_root"), zero("hop")))
    degree = tree.groupBy("root_id", F.col("source_id").alias("post_id")).agg(F.count("*").alias("children"))
    wrote = authors.groupBy("root_id", F.col("content_id").alias("post_id")).agg(F.min("author_id").alias("author_id"))
    posts = posts.join(degree, ["root_id", "post_id"], "left").join(wrote, ["root_id", "post_id"], "left").join(prior_cascades(tree, authors), ["root_id", "author_id"], "left")
    order = F.struct((1 - F.col("is_root")).alias("later"), "t", "post_id")
    posts = posts.withColumn("order_", order)
    first = posts.where("author_id IS NOT NULL").groupBy("root_id", "author_id").agg(F.min("order_").alias("first_"))
    posts = posts.join(first, ["root_id", "author_id"], "left")
    repeat = F.coalesce((F.col("order_") > F.col("first_")).cast("double"), F.lit(0.0))
    posts = posts.withColumns({"log_out_degree": F.log1p(F.coalesce("children", F.lit(0))), "log_prior_author": F.log1p(F.coalesce("prior", F.lit(0))), "author_repeat": repeat})
    # places by stretches of time, each numbered by itself
    posts = posts.withColumn("stretch_", F.when(F.col("is_root") == 1, -(2**62)).otherwise(F.floor(F.col("t") / STRETCH_S)))
    sizes = posts.groupBy("root_id", "stretch_").agg(F.count("*").alias("n_"))
    earlier = Window.partitionBy("root_id").orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("root_id", "stretch_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"))
    inside = F.row_number().over(Window.partitionBy("root_id", "stretch_").orderBy("order_")) - 1
    return posts.withColumn("inside_", inside).join(sizes, ["root_id", "stretch_"]).select("root_id", "post_id", (F.col("before_") + F.col("inside_")).cast("long").alias("place"), "t", *INPUTS)


def edge_index(tree: DataFrame, posts: DataFrame) -> DataFrame:
    """(root_id, source, target): the places of both ends of each reshare edge."""
    place = lambda end, name: posts.select("root_id", F.col("post_id").alias(end), F.col("place").alias(name))
    e = tree.select("root_id", "source_id", "target_id").distinct()
    return e.join(place("source_id", "source"), ["root_id", "source_id"]).join(place("target_id", "target"), ["root_id", "target_id"]).select("root_id", "source", "target")


def passed(posts: DataFrame, edges: DataFrame, columns: list[str], own: float = 1.0, down: float = 1.0, up: float = 1.0) -> DataFrame:
    """One layer: each post's columns become ``own`` times its own, ``down`` times its parents' and ``up`` times its children's summed.

    ``posts`` (root_id, place, *columns), ``edges`` (root_id, source, target). What a post gets is
    added up before the join, so a post with very many children costs a partial sum.
    """

    def along(sender: str, receiver: str, weight: float) -> DataFrame:
        sent = edges.join(posts.withColumnRenamed("place", sender), ["root_id", sender])
        return sent.select("root_id", F.col(receiver).alias("place"), *[(F.col(c) * weight).alias(c) for c in columns])

    kept = posts.select("root_id", "place", *[(F.col(c) * own).alias(c) for c in columns])
    every = kept.union(along("source", "target", down)).union(along("target", "source", up))
    return every.groupBy("root_id", "place").agg(*[F.sum(c).alias(c) for c in columns])


def readout(posts: DataFrame, columns: list[str], layer: int) -> DataFrame:
    """Mean and maximum of each column over a cascade."""
    return posts.groupBy("root_id").agg(*[f(c).alias(f"{c}_{k}_{layer}") for c in columns for k, f in (("mean", F.avg), ("max", F.max))])


def pooled(posts: DataFrame, edges: DataFrame, layers: int = 2, columns: list[str] | None = None) -> DataFrame:
    """(root_id, log_size, and of each layer from 0 on mean and maximum of each column): what a reader of the graph gets to see."""
    columns = columns or INPUTS
    now = written(posts.select("root_id", "place", *columns), "layer")
    edges = written(edges, "edges")
    out = now.groupBy("root_id").agg(F.log(F.count("*").cast("double")).alias("log_size")).join(readout(now, columns, 0), "root_id")
    for k in range(1, layers + 1):
        now = written(passed(now, edges, columns), "layer")
        out = out.join(readout(now, columns, k), "root_id")
    return out


def graphs(tree: DataFrame, authors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts with their inputs, edge index), written once."""
    posts = written(post_inputs(tree, authors), "posts")
    return posts, edge_index(tree, posts)
