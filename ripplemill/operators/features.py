"""37 features of reshare cascades, a family at a time, one row a root."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import reshare_trees, structural_virality, tree_authors
from .working import finely_dealt, written

REUSE_S = 21600.0


def tree_roots(tree: DataFrame, authors: DataFrame) -> DataFrame:
    """(root_id, n, t0, platform0): edges, and time and platform of the root's own post or else its first child's."""
    own = authors.where("content_id = root_id").groupBy("root_id").agg(F.min("t").alias("at"), F.min_by("platform", "t").alias("p"))
    e = tree.groupBy("root_id").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.min_by("platform", F.struct("t", "target_id")).alias("first_p"))
    return e.join(own, "root_id", "left").select("root_id", "n", F.coalesce("at", "first").alias("t0"), F.coalesce("p", "first_p").alias("platform0"), F.col("first").alias("start"))


def structure(tree: DataFrame) -> DataFrame:
    per_source = tree.groupBy("root_id", "source_id").agg(F.count("*").alias("c"))
    sources = per_source.groupBy("root_id").agg(F.count("*").alias("k"), F.avg("c").alias("mean_children"), F.max("c").alias("max_children"), F.avg((F.col("c") >= 2).cast("double")).alias("branching_frac"))
    widths = tree.groupBy("root_id", "depth").agg(F.count("*").alias("w")).groupBy("root_id").agg(F.max("w").alias("width"))
    e = tree.groupBy("root_id").agg((F.count("*") + 1).alias("size"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"), F.count_if(F.col("source_id") == F.col("root_id")).alias("root_fanout"))
    j = e.join(sources, "root_id").join(widths, "root_id")
    return j.select(
        "root_id", "size", "max_depth", "root_fanout", (F.col("root_fanout") / (F.col("size") - 1)).alias("root_fanout_share"),
        "mean_children", "max_children", (F.col("max_depth") / F.col("size")).alias("depth_over_size"),
        ((F.col("size") - F.col("k")) / F.col("size")).alias("leaf_frac"), "mean_depth", (F.col("width") / F.col("size")).alias("max_width_frac"), "branching_frac",
    )


def with_parent(tree: DataFrame, root: DataFrame) -> DataFrame:
    """Tree edges with the time and platform of the parent post; unknown parents give nulls."""
    parents = tree.select("root_id", F.col("target_id").alias("source_id"), F.col("t").alias("pt"), F.col("platform").alias("pp")).union(root.select("root_id", "root_id", "t0", "platform0"))
    return tree.join(parents, ["root_id", "source_id"], "left")


def timing(tree: DataFrame, authors: DataFrame) -> DataFrame:
    root = tree_roots(tree, authors)
    e = with_parent(tree, root).join(root.select("root_id", "t0", "n"), "root_id")
    order = Window.partitionBy("root_id").orderBy("t", "target_id")
    rate = Window.partitionBy("root_id").orderBy("t").rangeBetween(0, 60)
    e = e.withColumn("i", F.row_number().over(order)).withColumn("rate", F.count("*").over(rate)).withColumn("gap", F.col("t") - F.coalesce(F.lag("t").over(order), F.col("t0"))).withColumn("delay", F.col("t") - F.col("pt"))
    e = e.withColumn("before", F.lag("gap").over(order))
    e = e.withColumn("log_delay", F.log(F.greatest("delay", F.lit(1.0)))).withColumn("same", F.col("pp") == F.col("platform"))
    a = e.groupBy("root_id").agg(
        F.percentile("delay", 0.5).alias("m"), F.avg("delay").alias("mean"), F.stddev_pop("delay").alias("std"),
        (F.max("t") - F.first("t0")).alias("duration_s"), (F.max(F.when(F.col("i") == F.greatest(F.ceil(F.col("n") / 2), F.lit(1)), F.col("t"))) - F.first("t0")).alias("time_to_half_s"),
        F.max("rate").cast("double").alias("peak_rate_per_min"),
        F.avg("gap").alias("gm"), F.stddev_pop("gap").alias("gs"), F.corr("before", "gap").alias("memory"), F.count("gap").alias("gaps"),
        *[x.alias(f"{name}_{k}") for k, c in (("same", F.when(F.col("same"), F.col("log_delay"))), ("all", F.col("log_delay"))) for name, x in (("lmean", F.avg(c)), ("lstd", F.stddev_pop(c)), ("liqr", F.percentile(c, 0.75) - F.percentile(c, 0.25)))],
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.select(
        "root_id", zero(F.col("m")).alias("delay_median_s"), zero(F.col("mean")).alias("delay_mean_s"), zero(F.col("std")).alias("delay_std_s"),
        zero(F.when(F.col("mean") > 0, F.col("std") / F.col("mean"))).alias("delay_cv"), "duration_s", "time_to_half_s", "peak_rate_per_min",
        zero(F.when(F.col("gs") + F.col("gm") != 0, (F.col("gs") - F.col("gm")) / (F.col("gs") + F.col("gm")))).alias("arrival_burstiness"),
        zero(F.when((F.col("gaps") >= 3) & ~F.isnan("memory"), F.col("memory"))).alias("arrival_memory"),
        *[zero(F.coalesce(f"{c}_same", f"{c}_all")).alias(n) for c, n in (("lmean", "log_delay_mean"), ("lstd", "log_delay_std"), ("liqr", "log_delay_iqr"))],
    )


def platforms(tree: DataFrame, authors: DataFrame) -> DataFrame:
    root = tree_roots(tree, authors)
    e = with_parent(tree, root).join(root.select("root_id", "t0"), "root_id")
    crossed = F.col("pp").isNull() | (F.col("pp") != F.col("platform"))
    return e.groupBy("root_id").agg(
        F.countDistinct("platform").alias("n_platforms"), F.avg(crossed.cast("double")).alias("cross_platform_edge_frac"),
        F.coalesce(F.min(F.when(crossed, F.col("t"))) - F.first("t0"), F.lit(-1.0)).alias("first_hop_lag_s"),
    )


def _shared_authors(tree: DataFrame, authors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root_id, author_id, k): posts of each author in each cascade; and (c, author_id, p): cascades p within the six hours before c that the author wrote in too."""
    root = tree_roots(tree, authors).select("root_id", "start")
    rows = authors.join(root.withColumn("ord", F.struct("start", "root_id")), "root_id")
    per = rows.groupBy("root_id", "author_id").agg(F.count("*").alias("k"), F.first("ord").alias("ord"))
    # equi-join on the author with a range, in time buckets of the window's length so that a busy author is split
    bucket = lambda c: F.floor(c / REUSE_S)
    now = per.select(F.col("root_id").alias("c"), "author_id", F.col("ord").alias("co"), F.explode(F.array(bucket(F.col("ord.start")), bucket(F.col("ord.start")) - 1)).alias("bucket"))
    past = per.select(F.col("root_id").alias("p"), "author_id", F.col("ord").alias("po"), bucket(F.col("ord.start")).alias("bucket"))
    both = now.join(past, ["author_id", "bucket"]).where((F.col("po") < F.col("co")) & (F.col("po.start") >= F.col("co.start") - REUSE_S))
    return per, both


def prior_cascades(tree: DataFrame, authors: DataFrame) -> DataFrame:
    """(root_id, author_id, prior): in how many cascades of the six hours before this one each of its authors wrote."""
    return _prior(*_shared_authors(tree, authors))


def _prior(per: DataFrame, both: DataFrame) -> DataFrame:
    return per.select("root_id", "author_id").join(both.groupBy(F.col("c").alias("root_id"), "author_id").agg(F.countDistinct("p").alias("prior")), ["root_id", "author_id"], "left").fillna(0, ["prior"])


def author_reuse(tree: DataFrame, authors: DataFrame) -> DataFrame:
    """How far a cascade's authors also wrote in cascades that started in the six hours before it."""
    per, both = (written(x, "shared") for x in _shared_authors(tree, authors))
    own = per.groupBy("root_id").agg(F.sum("k").alias("rows"), F.count("*").alias("authors"))
    most = per.groupBy("root_id").agg(F.max("k").alias("most"))
    p = _prior(per, both).groupBy("root_id").agg(F.avg("prior").alias("prior_author_mean"), F.max("prior").alias("prior_author_max"), F.avg((F.col("prior") > 0).cast("double")).alias("prior_author_frac"), F.percentile("prior", 0.75).alias("prior_author_p75"), F.avg((F.col("prior") >= 3).cast("double")).alias("prior_author_frac_ge3"))
    shared = both.groupBy(F.col("c").alias("root_id"), "p").agg(F.countDistinct("author_id").alias("shared"))
    linked = both.select(F.col("c").alias("root_id"), "p", "author_id").distinct().join(shared.where("shared >= 2"), ["root_id", "p"]).groupBy("root_id").agg(F.countDistinct("author_id").alias("linked"))
    j = own.join(most, "root_id").join(p, "root_id").join(shared.groupBy("root_id").agg(F.max("shared").alias("shared")), "root_id", "left").join(linked, "root_id", "left")
    return j.select(
        "root_id", (F.col("authors") / F.col("rows")).alias("unique_author_ratio"), (F.col("most") / F.col("rows")).alias("max_author_share"),
        "prior_author_mean", "prior_author_max", "prior_author_frac", "prior_author_p75", "prior_author_frac_ge3",
        (F.coalesce("linked", F.lit(0)) / F.col("authors")).alias("coauthor_linked_frac"), (F.coalesce("shared", F.lit(0)) / F.col("authors")).alias("coauthor_overlap_max"),
    )


#: The features that depend on other cascades.
HISTORY = ["prior_author_mean", "prior_author_max", "prior_author_frac", "prior_author_p75", "prior_author_frac_ge3", "coauthor_linked_frac", "coauthor_overlap_max"]


def alone(tree: DataFrame, authors: DataFrame) -> DataFrame:
    """``author_reuse`` of each cascade by itself: with no other before it, all that depends on history is 0."""
    own = authors.join(tree.select("root_id").distinct(), "root_id", "left_semi").groupBy("root_id", "author_id").agg(F.count("*").alias("k"))
    own = own.groupBy("root_id").agg((F.count("*") / F.sum("k")).alias("unique_author_ratio"), (F.max("k") / F.sum("k")).alias("max_author_share"))
    return own.select("*", *[F.lit(0.0).alias(c) for c in HISTORY])


def root_attachment(tree: DataFrame, steps: int = 200) -> DataFrame:
    """The share a of children that choose the root (else any earlier post alike) of greatest likelihood, on a grid."""
    i = F.row_number().over(Window.partitionBy("root_id").orderBy("t", "target_id")) - 1
    e = tree.select("root_id", (F.col("source_id") == F.col("root_id")).cast("double").alias("is_root"), i.alias("i"))
    # the window has dealt the rows by root, so that neither the grid nor its sums are shuffled
    g = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("a", F.col("k") / steps)
    x = F.col("a") * F.col("is_root") + (1 - F.col("a")) / (F.col("i") + 1)
    ll = g.groupBy("root_id", "k").agg(F.sum(F.when(x > 0, F.log(x)).otherwise(F.lit(-1e300))).alias("ll"))
    return ll.groupBy("root_id").agg((F.max_by("k", F.struct(F.round("ll", 9), -F.col("k"))) / steps).alias("root_attach_mle"))


def all_features(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All families joined. What they all read is written once, and each family by itself, so that a task holds what one of them sorts."""
    with finely_dealt(edges.sparkSession, edges.where("edge_type = 'reshare'").count()):
        roots = written(roots, "roots")
        tree = written(reshare_trees(edges, roots), "tree")
        authors = written(tree_authors(edges, tree, roots), "authors")
        out = structure(tree)
        for part in (timing(tree, authors), platforms(tree, authors), author_reuse(tree, authors), structural_virality(tree), root_attachment(tree)):
            out = out.join(written(part, "family"), "root_id", "left")
        return written(out.fillna(0), "features")
