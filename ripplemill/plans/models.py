"""Queries of second models, gates, versioned search and paired features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deferral as D
from ..operators import evaluation as E
from ..operators import features as C
from ..operators import learning as L
from ..operators import versioned as I
from ..operators.working import written
from ..sources.tables import table
from .cases import _features, query
from .oracles import ORACLE_SQL
from .queries import _r, _scored, _tree

#: Gates by two scores, as SQL: how many rows each publishes, and how many of them are right.
GATES = """gt AS (SELECT round(0.05::DOUBLE + k * 0.01::DOUBLE, 2) AS threshold FROM range(0, 94) g(k)), rw AS (SELECT *, greatest(p, 1 - p) AS confidence, ((p >= 0.5)::INT = y)::INT AS correct FROM s),
 cq AS (SELECT threshold, count(*) / (SELECT count(*) FROM rw) AS coverage, avg(correct) AS accuracy, count(*) AS k FROM gt JOIN rw ON q >= threshold GROUP BY 1), cc AS (SELECT threshold, count(*) / (SELECT count(*) FROM rw) AS coverage, avg(correct) AS accuracy FROM gt JOIN rw ON confidence >= threshold GROUP BY 1)"""


def _gated(spark, sf):
    s = _scored(spark, sf)
    return s.withColumns({"p_correct": F.col("q"), "confidence": D.confidence(F.col("p")), "correct": D.correct(F.col("p"), F.col("y"))})


@query(f", {GATES} SELECT round(threshold, 2) AS threshold, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy, k AS n FROM cq")
def e7_gate_curve(spark, sf):
    """What each gate on a second model's score publishes, and how much of it is right."""
    return D.gate_curve(_gated(spark, sf), "p_correct").transform(_r)


@query(
    f", {GATES}, tg(target) AS (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.925::DOUBLE), (0.97::DOUBLE)), ok AS (SELECT target, cq.*, accuracy >= target AS hit FROM tg, cq WHERE coverage >= 0.25), "
    "ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY NOT hit, CASE WHEN hit THEN -coverage ELSE -accuracy END, CASE WHEN hit THEN threshold ELSE -threshold END) AS r FROM ok) WHERE r = 1), "
    "mt AS (SELECT ch.*, cc.threshold AS other_threshold, cc.accuracy AS other_accuracy, row_number() OVER (PARTITION BY target ORDER BY abs(cc.coverage - ch.coverage), cc.threshold) AS z FROM ch, cc) "
    "SELECT target, round(threshold, 2) AS threshold, round(accuracy, 6) AS accuracy, round(coverage, 6) AS coverage, round(other_threshold, 2) AS other_threshold, round(other_accuracy, 6) AS other_accuracy FROM mt WHERE z = 1"
)
def e7_gates_at_equal_coverage(spark, sf):
    """The gate of each target accuracy, and the confidence gate that publishes as much."""
    return D.compare_gates(_gated(spark, sf), [0.5, 0.9, 0.925, 0.97]).transform(_r)


@query(
    f", {GATES}, gs AS (SELECT row_id % 3 AS subtype, 'deferral' AS gate, correct, q >= 0.4 AS pub FROM rw UNION ALL SELECT row_id % 3, 'confidence', correct, confidence >= 0.7 FROM rw) SELECT subtype, gate, count(*) AS n, round(avg(pub::INT), 6) AS published, round(avg(correct) FILTER (pub), 6) AS accuracy FROM gs GROUP BY 1, 2"
)
def e7_published_by_subtype(spark, sf):
    rows = _gated(spark, sf).withColumn("subtype", F.col("row_id") % 3)
    return D.published(rows, "subtype", {"deferral": ("p_correct", 0.4), "confidence": ("confidence", 0.7)}).transform(_r)


@query()
def e7_deferral(spark, sf):
    """A second model fitted on out-of-fold verdicts of the first, its gates against confidence on rows that neither has seen."""
    rows, columns = _features(spark, sf)
    split = F.pmod(F.xxhash64("row_id"), F.lit(5)) < 4
    train, held = written(rows.where(split), "train"), written(rows.where(~split), "held")
    second = D.fit_deferral(train, columns, L.trees(columns, 5), 3, 5)
    scored = D.deferred(second, L.scored(L.trees(columns, 5).fit(train), held))
    return D.compare_gates(scored).transform(_r)


# --- search


@query()
def v2_versioned_search(spark, sf):
    """Nearest vectors of each query's own version, from the cells near it."""
    v = table(spark, sf, "embeddings").withColumnRenamed("label", "version")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "version")
    return I.VersionedIndex.build(v).search(q).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query()
def v2_all_cells(spark, sf):
    """The same with every cell of the version: exact, and still without reading any other version."""
    v = table(spark, sf, "embeddings").withColumnRenamed("label", "version")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "version")
    return I.VersionedIndex.build(v).search(q, probes=I.MOST_CELLS).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


ORACLE_SQL["v2_all_cells"] = ORACLE_SQL["v1_top_k"]


@query()
def v4_selectivity_table(spark, sf):
    """Recall, rows and time of three ways to search a version that is 5, 10 and 20 per cent of all vectors."""
    v, q = _vectors(spark, sf)
    return I.selectivity(v, q, [0.05, 0.1, 0.2])


def _vectors(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


# --- features in and out of context


_REUSE = ORACLE_SQL["c4_author_reuse"]


@query()
def e14_reuse_alone(spark, sf):
    """Author features of each cascade in context beside those of the cascade by itself."""
    tree, authors = _tree(spark, sf)
    authors = written(authors, "authors")
    one = C.alone(tree, authors)
    both = C.author_reuse(tree, authors).join(one.select("root_id", *[F.col(c).alias(f"{c}_alone") for c in one.columns if c != "root_id"]), "root_id")
    return both.transform(_r)


ORACLE_SQL["e14_reuse_alone"] = (
    "SELECT *, unique_author_ratio AS unique_author_ratio_alone, max_author_share AS max_author_share_alone, " + ", ".join(f"0.0::DOUBLE AS {c}_alone" for c in C.HISTORY) + f" FROM ({_REUSE})"
)


@query()
def e14_skew(spark, sf):
    """ROC-AUC of a model fitted in context, on features in context and on features of each cascade alone."""
    rows, columns = _features(spark, sf)
    alone = rows.select(*[F.lit(0.0).alias(c) if c in C.HISTORY else F.col(c) for c in rows.columns])
    return L.skew(L.trees(columns, 5), rows, alone, 3).transform(_r)


@query()
def m3_nested_search(spark, sf):
    rows, columns = _features(spark, sf)
    return L.nested_search(rows, columns, 3, 2, (2, 3), (2, 5)).transform(_r)


@query(
    """, sh AS (SELECT root_id, count(*) + 1 AS size, max(depth) AS max_depth FROM tree GROUP BY 1), lf AS (SELECT unnest(['size', 'max_depth']) AS metric, unnest([size, max_depth]) AS v, substr(root_id, 4)::INT // 20 % 2 = 0 AS re FROM sh)
 SELECT metric, quantile_cont(v, 0.5) FILTER (re)::DOUBLE AS real_p50, quantile_cont(v, 0.9) FILTER (re)::DOUBLE AS real_p90, quantile_cont(v, 0.5) FILTER (NOT re)::DOUBLE AS other_p50, quantile_cont(v, 0.9) FILTER (NOT re)::DOUBLE AS other_p90 FROM lf GROUP BY 1"""
)
def e12_shape_comparison(spark, sf):
    """Sizes and depths of two populations of cascades."""
    f = written(C.structure(_tree(spark, sf)[0]), "structure")
    even = F.substring("root_id", 4, 20).cast("long") / 20 % 2 == 0
    return E.shape_comparison(f.where(even), f.where(~even), ["size", "max_depth"]).transform(_r)


@query(
    """, rp AS (SELECT row_id % 3 AS arm, row_id % 5 AS rep, avg(((p >= 0.5)::INT = y)::INT) AS accuracy, avg((p - y) * (p - y)) AS brier FROM s GROUP BY 1, 2), lp AS (SELECT arm, unnest(['accuracy', 'brier']) AS metric, unnest([CASE WHEN rep = 4 AND arm = 1 THEN NULL ELSE accuracy END, brier]) AS v FROM rp)
 SELECT arm, metric, round(avg(v), 6) AS mean, round(min(v), 6) AS least, round(max(v), 6) AS most, count(v) AS repeats FROM lp WHERE v IS NOT NULL GROUP BY 1, 2"""
)
def e13_spread(spark, sf):
    """Mean, least and most of two scores over five repeats; one of them is undefined."""
    s = _scored(spark, sf).withColumns({"arm": F.col("row_id") % 3, "rep": F.col("row_id") % 5})
    r = s.groupBy("arm", "rep").agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")).alias("accuracy"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))
    r = r.withColumn("accuracy", F.when((F.col("rep") == 4) & (F.col("arm") == 1), float("nan")).otherwise(F.col("accuracy")))
    return E.spread(r, ["arm"], ["accuracy", "brier"]).transform(_r)
