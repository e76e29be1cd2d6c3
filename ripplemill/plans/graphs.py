"""Queries over cascades as graphs of posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import tensors as N
from ..operators.working import written
from ..sources.tables import graph
from .cases import query
from .queries import _r

#: A post of each cascade with its eight inputs, as SQL; and its place.
POSTS = """st AS (SELECT root_id, min(t) AS start FROM tree GROUP BY 1),
 ca AS (SELECT DISTINCT 'ev:' || (cascade * 20) AS root_id, author_id FROM p), cs AS (SELECT ca.*, start FROM ca JOIN st USING (root_id)),
 pr AS (SELECT x.root_id, x.author_id, count(y.root_id) AS prior FROM cs x LEFT JOIN cs y ON x.author_id = y.author_id AND (y.start, y.root_id) < (x.start, x.root_id) AND y.start >= x.start - 21600 GROUP BY ALL),
 po AS (SELECT root_id, root_id AS post_id, NULL::VARCHAR AS parent_id, 0 AS depth, true AS top FROM roots UNION ALL SELECT root_id, target_id, source_id, depth, false FROM tree),
 pa AS (SELECT po.*, c.t, c.platform, c.author_id, u.t AS pt, u.platform AS pp, z.t AS t0 FROM po JOIN p c ON c.content_id = post_id LEFT JOIN p u ON u.content_id = po.parent_id JOIN p z ON z.content_id = root_id),
 nd AS (SELECT root_id, post_id, row_number() OVER w - 1 AS place, top::INT::DOUBLE AS is_root, depth / 5.0::DOUBLE AS depth, ln(1 + greatest(coalesce(t - pt, 0), 0)) / 5.0::DOUBLE AS log_delay, ln(1 + greatest(t - t0, 0)) / 5.0::DOUBLE AS log_since_root,
  (NOT top AND pp IS DISTINCT FROM platform)::INT::DOUBLE AS hop, ln(1 + (SELECT count(*) FROM tree x WHERE x.root_id = pa.root_id AND x.source_id = post_id)) AS log_out_degree, ln(1 + prior) AS log_prior_author,
  (row_number() OVER (PARTITION BY root_id, author_id ORDER BY NOT top, t, post_id) > 1)::INT::DOUBLE AS author_repeat FROM pa JOIN pr USING (root_id, author_id) WINDOW w AS (PARTITION BY root_id ORDER BY NOT top, t, post_id))"""
LONG = "h0 AS MATERIALIZED (SELECT root_id, place, unnest(['is_root', 'depth', 'log_delay', 'log_since_root', 'hop', 'log_out_degree', 'log_prior_author', 'author_repeat']) AS c, unnest([is_root, depth, log_delay, log_since_root, hop, log_out_degree, log_prior_author, author_repeat]) AS x FROM nd), ed AS (SELECT tree.root_id, a.place AS source, b.place AS target FROM tree JOIN nd a ON a.root_id = tree.root_id AND a.post_id = source_id JOIN nd b ON b.root_id = tree.root_id AND b.post_id = target_id)"
LAYER = "h{k} AS MATERIALIZED (SELECT root_id, place, c, sum(x) AS x FROM (SELECT * FROM h{j} UNION ALL SELECT root_id, target, c, x FROM h{j} JOIN ed USING (root_id) WHERE place = source UNION ALL SELECT root_id, source, c, x FROM h{j} JOIN ed USING (root_id) WHERE place = target) GROUP BY ALL)"


def _graphs(spark, sf):
    g = graph(spark, sf)
    roots = written(G.cascade_roots(g.edges), "roots")
    tree = written(G.reshare_trees(g.edges, roots), "tree")
    return tree, N.graphs(tree, written(G.tree_authors(g.edges, tree, roots), "authors"))


@query(f", {POSTS} SELECT root_id, post_id, place, {', '.join(f'round({c}, 6) AS {c}' for c in N.INPUTS)} FROM nd")
def g13_post_inputs(spark, sf):
    """Eight inputs of each post of each cascade, and its place in it."""
    return _graphs(spark, sf)[1][0].drop("t").transform(_r)


@query(f", {POSTS}, {LONG} SELECT * FROM ed")
def g13_edge_index(spark, sf):
    return _graphs(spark, sf)[1][1].transform(_r)


@query(
    f", {POSTS}, {LONG}, {LAYER.format(k=1, j=0)}, {LAYER.format(k=2, j=1)}, hs AS (SELECT *, 0 AS k FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2), "
    "sz AS (SELECT root_id, round(ln(count(*)), 4) AS log_size FROM nd GROUP BY 1) SELECT root_id, k AS layer, c AS input, round(avg(x), 4) AS mean, round(max(x), 4) AS most, any_value(log_size) AS log_size FROM hs JOIN sz USING (root_id) GROUP BY 1, 2, 3"
)
def m6_pooled_messages(spark, sf):
    """Two layers of messages along reshares in both directions, read out of each cascade as mean and maximum."""
    _, (posts, edges) = _graphs(spark, sf)
    wide = N.pooled(posts, edges, 2)
    each = F.array(*[F.struct(F.lit(k).alias("layer"), F.lit(c).alias("input"), F.col(f"{c}_mean_{k}").alias("mean"), F.col(f"{c}_max_{k}").alias("most")) for k in range(3) for c in N.INPUTS])
    return wide.select("root_id", "log_size", F.explode(each).alias("x")).select("root_id", "x.layer", "x.input", "x.mean", "x.most", "log_size").transform(lambda d: _r(d, 4))
