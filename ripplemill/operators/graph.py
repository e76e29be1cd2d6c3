"""Traversal of the propagation graph by joins.

From one node, levels are joined one after another, each written before the next. For all
cascades at once, steps are doubled: paths of exactly k edges joined with themselves give those
of 2k, and a path of any length is one of each power of two in it, so a depth of 40 takes six
joins instead of forty, and what is kept is a row a post, not a row a pair of posts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .working import written

TREE_DEPTH = 40


def propagation_path(edges: DataFrame, root: str, max_depth: int = 6) -> DataFrame:
    """All paths from ``root``: one row an edge of a path, with its depth. Cycles end at the depth limit."""
    columns = [c for c in ("source_id", "target_id", "edge_type", "platform", "ts", "t") if c in edges.columns]
    level = edges.where(F.col("source_id") == F.lit(root)).select(*columns, F.lit(1).alias("depth"))
    levels = [written(level, "level")]
    for depth in range(2, max_depth + 1):
        reached = levels[-1].groupBy(F.col("target_id").alias("source_id")).agg(F.count("*").alias("times"))
        # a node that several paths reach is left by each of them
        level = edges.join(reached, "source_id").select(*columns, F.lit(depth).alias("depth"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")
        level = written(level, "level")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.union, levels)


def ancestries(edges: DataFrame, max_depth: int = TREE_DEPTH) -> DataFrame:
    """(node, above, d): every path of at most ``max_depth`` edges that leads down from ``above`` to ``node``, by doubling."""
    exact = found = written(edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("above"), F.lit(1).alias("d")), "paths")
    k = 1
    while k < max_depth:
        # from a path of k edges on upwards, by a shorter one or one as long: each longer path arises once
        more = found.select(F.col("node").alias("above"), F.col("above").alias("top"), F.col("d").alias("e"))
        longer = written(exact.join(more, "above").where(F.col("d") + F.col("e") <= max_depth).select("node", F.col("top").alias("above"), (F.col("d") + F.col("e")).alias("d")), "paths")
        found, k = found.union(longer), 2 * k
        exact = longer.where(F.col("d") == k)
        if exact.isEmpty():
            break
    return found


def descents(edges: DataFrame, roots: DataFrame, max_depth: int = TREE_DEPTH) -> DataFrame:
    """(root_id, node, d): every path of at most ``max_depth`` edges down from each root, the empty one too. A node that several paths lead to is there for each."""
    exact = written(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")), "steps")
    parts, k = [roots.select("root_id", F.col("root_id").alias("node"), F.lit(0).alias("d"))], 1
    while k <= max_depth and not exact.isEmpty():
        # lengths below k are there; each of them goes k further
        reach = reduce(DataFrame.union, parts)
        further = reach.join(exact, F.col("node") == F.col("a")).where(F.col("d") + k <= max_depth)
        parts.append(written(further.select("root_id", F.col("b").alias("node"), (F.col("d") + k).alias("d")), "reach"))
        if 2 * k <= max_depth:
            exact = written(exact.join(exact.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")), "steps")
        k *= 2
    return reduce(DataFrame.union, parts)


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """(root_id, node, s): how many posts are at or below each post of each cascade, by doubling; ``tree`` (root_id, source_id, target_id), a post has one parent."""
    exact = written(tree.select("root_id", F.col("source_id").alias("a"), F.col("target_id").alias("b")), "steps")
    sizes = written(exact.select("root_id", F.col("a").alias("node")).union(exact.select("root_id", "b")).distinct().withColumn("s", F.lit(1).cast("long")), "sizes")
    while not exact.isEmpty():
        # posts less than k below are counted; those k below bring what is less than k below them
        more = exact.join(sizes.withColumnRenamed("node", "b"), ["root_id", "b"]).groupBy("root_id", F.col("a").alias("node")).agg(F.sum("s").alias("more"))
        sizes = written(sizes.join(more, ["root_id", "node"], "left").select("root_id", "node", (F.col("s") + F.coalesce("more", F.lit(0))).alias("s")), "sizes")
        exact = written(exact.join(exact.select("root_id", F.col("a").alias("b"), F.col("b").alias("c")), ["root_id", "b"]).select("root_id", "a", F.col("c").alias("b")), "steps")
    return sizes


def on_platform(edges: DataFrame, platform: str | None = None) -> DataFrame:
    return edges if platform is None else edges.where(F.col("platform") == F.lit(platform))


def cascade_size(edges: DataFrame, root: str, max_depth: int = 10) -> DataFrame:
    """How many different nodes are reached from ``root``, itself if a cycle leads back: each node goes on once, however many paths lead to it."""
    steps = written(edges.select("source_id", "target_id").distinct(), "steps")
    new = written(steps.where(F.col("source_id") == F.lit(root)).select(F.col("target_id").alias("id")).distinct(), "level")
    seen = [new]
    for _ in range(1, max_depth):
        known = reduce(DataFrame.union, seen)
        new = written(steps.join(new, F.col("source_id") == F.col("id"), "left_semi").select(F.col("target_id").alias("id")).distinct().join(known, "id", "left_anti"), "level")
        if new.isEmpty():
            break
        seen.append(new)
    return reduce(DataFrame.union, seen).agg(F.count("*").alias("size"))


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree of every node; a loop counts in both."""
    ends = edges.select(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("target_id", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def top_nodes(edges: DataFrame, since, limit: int) -> DataFrame:
    return edges.where(F.col("t") >= since).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(limit)


def cascade_roots(edges: DataFrame, exclude: str | None = None, limit: int | None = None) -> DataFrame:
    """Reshared posts that are nobody's child; without those whose id begins with ``exclude``, and the first ``limit`` by id."""
    r = edges.where("edge_type = 'reshare'")
    tops = r.select(F.col("source_id").alias("root_id"))
    tops = tops if exclude is None else tops.where(~F.col("root_id").startswith(exclude))
    roots = tops.distinct().join(r.select(F.col("target_id").alias("root_id")), "root_id", "left_anti")
    return roots if limit is None else roots.orderBy("root_id").limit(limit)


def reshare_trees(edges: DataFrame, roots: DataFrame, max_depth: int = TREE_DEPTH) -> DataFrame:
    """(root_id, source_id, target_id, ts, t, platform, depth) for all roots at once."""
    r = edges.where("edge_type = 'reshare'").select("source_id", "target_id", "ts", "t", "platform")
    above = descents(r, roots, max_depth - 1).withColumnRenamed("node", "source_id")
    return r.join(above, "source_id").select("root_id", "source_id", "target_id", "ts", "t", "platform", (F.col("d") + 1).alias("depth"))


def tree_authors(edges: DataFrame, tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, content_id, author_id, t, platform) of the posts of each tree, the root's too."""
    posts = tree.select("root_id", F.col("target_id").alias("content_id")).union(roots.select("root_id", F.col("root_id").alias("content_id")))
    a = edges.where("edge_type = 'authored'").select(F.col("target_id").alias("content_id"), F.col("source_id").alias("author_id"), "t", "platform")
    return posts.join(a, "content_id").select("root_id", "content_id", "author_id", "t", "platform")


def structural_virality(tree: DataFrame) -> DataFrame:
    """Mean distance of all pairs of a tree's posts, from the sizes of the subtrees below its edges. ``tree``: ``reshare_trees``; of several parents a post keeps the first."""
    first = tree.groupBy("root_id", "target_id").agg(F.min_by("source_id", F.struct("depth", "t", "source_id")).alias("source_id"))
    s = subtree_sizes(first).where("node <> root_id")
    per = s.groupBy("root_id").agg((F.count("*") + 1).alias("n"), F.sum("s").alias("s1"), F.sum(F.col("s") * F.col("s")).alias("s2"))
    return per.select("root_id", (2.0 * (F.col("n") * F.col("s1") - F.col("s2")) / (F.col("n") * (F.col("n") - 1))).alias("structural_virality"))


def above(edges: DataFrame, posts: DataFrame, hops: int) -> DataFrame:
    """The edges (source_id, target_id) that lead down to any of ``posts`` (node) within so many hops: levels upwards, each node once."""
    steps, posts = written(edges.select("source_id", "target_id"), "steps"), written(posts.select("node"), "posts")
    new, found, seen = posts, [], posts
    for _ in range(hops):
        level = written(steps.join(new.select(F.col("node").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id"), "level")
        if level.isEmpty():
            break
        found.append(level)
        up = level.select(F.col("source_id").alias("node")).distinct()
        # made of written levels only, so plans don't grow into each other
        new, seen = up.join(seen, "node", "left_anti"), seen.union(up)
    return reduce(DataFrame.union, found) if found else steps.where("false")


def entity_activity(edges: DataFrame, entity: str, window_s: float = 3600.0, top: int = 5, hops: int = 20) -> DataFrame:
    """One row: mentions in the window that ends at the entity's latest, authors, and the cascades they belong to."""
    m = edges.where((F.col("edge_type") == "mentions") & (F.col("target_id") == entity)).select(F.col("source_id").alias("content_id"), "t")
    m = m.crossJoin(F.broadcast(m.agg(F.max("t").alias("last")))).where(F.col("t") >= F.col("last") - window_s).select("content_id", "t")
    a = edges.where("edge_type = 'authored'").select(F.col("target_id").alias("content_id"), F.col("source_id").alias("author_id"))
    authors = m.join(a, "content_id").groupBy("author_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("authors"), F.max("n").alias("most"))
    posts = m.select(F.col("content_id").alias("node")).distinct()
    paths = ancestries(above(edges.where("edge_type = 'reshare'"), posts, hops), hops).join(posts, "node").select("node", F.struct("d", F.col("above").alias("root_id")).alias("top"))
    roots = paths.union(posts.select("node", F.struct(F.lit(0).alias("d"), F.col("node").alias("root_id")))).groupBy(F.col("node").alias("origin")).agg(F.max("top").alias("top")).select("origin", "top.root_id")
    per_root = m.join(roots, m["content_id"] == roots["origin"]).groupBy("root_id").agg(F.count("*").alias("mentions"))
    tops = per_root.orderBy(F.desc("mentions"), "root_id").limit(top).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct((-F.col("mentions")).alias("m"), "root_id"))), lambda x: F.concat(x["root_id"], F.lit("="), (-x["m"]).cast("string")))).alias("top_cascades"))
    return (
        m.agg(F.count("*").alias("mentions")).crossJoin(authors).crossJoin(per_root.agg(F.count("*").alias("cascades"))).crossJoin(tops)
        .select("mentions", "authors", F.round(F.col("most") / F.col("mentions"), 3).alias("top_author_share"), "cascades", "top_cascades")
    )


def window_roots(edges: DataFrame, root: str, seconds: float = 21600.0) -> DataFrame:
    """Roots with a reshare in the window that ends when ``root`` is first reshared."""
    r = edges.where("edge_type = 'reshare'")
    t0 = r.where(F.col("source_id") == root).agg(F.min("t").alias("t0"))
    live = r.crossJoin(F.broadcast(t0)).where((F.col("t") >= F.col("t0") - seconds) & (F.col("t") <= F.col("t0"))).select(F.col("source_id").alias("root_id")).distinct()
    return live.join(r.select(F.col("target_id").alias("root_id")), "root_id", "left_anti")


def trace(edges: DataFrame, root: str, rows: int = 12) -> DataFrame:
    """The first posts of one cascade, with seconds since the first."""
    tree = propagation_path(edges.where("edge_type = 'reshare'"), root, rows)
    first = Window.orderBy("t", "target_id")
    return tree.orderBy("t", "target_id").limit(rows).select("target_id", "depth", (F.col("t") - F.first("t").over(first)).alias("offset_s"))


def labelled_trace(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``trace`` rows with the label of each post (``nodes``: id, label); a post that was never captured says so."""
    label = nodes.where("label <> ''").groupBy(F.col("id").alias("target_id")).agg(F.min("label").alias("label"))
    return rows.join(label, "target_id", "left").fillna("(not captured)", ["label"])


def path_sample(path: DataFrame, rows: int = 25) -> DataFrame:
    """The first edges of a path by depth, time and target, with the number of all its edges."""
    total = path.agg(F.count("*").alias("edges_total"))
    return path.orderBy("depth", F.col("t").asc_nulls_last(), "target_id").limit(rows).select("source_id", "target_id", "depth").crossJoin(F.broadcast(total))
