"""SQL of the features of cascades that is made of several parts, and tails that SQL can state."""

from __future__ import annotations

import re

from ..operators import velocity as A
from ..sources.tables import graph, posts
from .cases import query
from .oracles import ORACLE_SQL, stated
from .queries import F, Window, _r

TIMING = """te AS (SELECT k.root_id, k.t, k.platform, q.t AS pt, q.platform AS pp, z.t AS t0, row_number() OVER w AS i, count(*) OVER (PARTITION BY k.root_id) AS n, count(*) OVER (PARTITION BY k.root_id ORDER BY k.t RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS rate, k.t - coalesce(lag(k.t) OVER w, z.t) AS gap
  FROM tree k JOIN p q ON q.content_id = k.source_id JOIN p z ON z.content_id = k.root_id WINDOW w AS (PARTITION BY k.root_id ORDER BY k.t, k.target_id)),
 tf AS (SELECT *, lag(gap) OVER (PARTITION BY root_id ORDER BY i) AS earlier, t - pt AS delay, ln(greatest(t - pt, 1)) AS ld, pp = platform AS same FROM te),
 tg AS (SELECT root_id, quantile_cont(delay, 0.5) AS m, avg(delay) AS mean, stddev_pop(delay) AS std, max(t) - any_value(t0) AS duration_s, max(t) FILTER (i = greatest(ceil(n / 2)::BIGINT, 1)) - any_value(t0) AS half, max(rate)::DOUBLE AS peak, avg(gap) AS gm, stddev_pop(gap) AS gs, corr(earlier, gap) AS mem, count(gap) AS gaps,
  avg(ld) FILTER (same) AS ms, avg(ld) AS ma, stddev_pop(ld) FILTER (same) AS ss, stddev_pop(ld) AS sa, quantile_cont(ld, 0.75) FILTER (same) - quantile_cont(ld, 0.25) FILTER (same) AS qs, quantile_cont(ld, 0.75) - quantile_cont(ld, 0.25) AS qa FROM tf GROUP BY 1)
 SELECT root_id, round(coalesce(m, 0), 3) AS delay_median_s, round(coalesce(mean, 0), 3) AS delay_mean_s, round(coalesce(std, 0), 3) AS delay_std_s, round(CASE WHEN mean > 0 THEN std / mean ELSE 0 END, 3) AS delay_cv, round(duration_s, 3) AS duration_s, round(half, 3) AS time_to_half_s, round(peak, 3) AS peak_rate_per_min,
  round(CASE WHEN gs + gm <> 0 THEN (gs - gm) / (gs + gm) ELSE 0 END, 3) AS arrival_burstiness, round(CASE WHEN gaps >= 3 AND mem IS NOT NULL AND NOT isnan(mem) THEN mem ELSE 0 END, 3) AS arrival_memory, round(coalesce(ms, ma, 0), 3) AS log_delay_mean, round(coalesce(ss, sa, 0), 3) AS log_delay_std, round(coalesce(qs, qa, 0), 3) AS log_delay_iqr FROM tg"""
ORACLE_SQL["c4_timing"] = stated("c4_timing", f", {TIMING}")

_WHOLE = ["size", "max_depth", "root_fanout", "max_children", "n_platforms", "prior_author_max"]
_FAMILIES = ["c4_structure", "c4_timing", "c4_platforms", "c4_author_reuse", "g12_structural_virality", "c4_root_attachment"]


def _unrounded(name: str) -> str:
    return re.sub(r", [36]\) AS", ", 12) AS", ORACLE_SQL[name])


_SHARES = """root_fanout_share mean_children depth_over_size leaf_frac mean_depth max_width_frac branching_frac delay_median_s delay_mean_s delay_std_s delay_cv duration_s time_to_half_s peak_rate_per_min arrival_burstiness
 arrival_memory log_delay_mean log_delay_std log_delay_iqr cross_platform_edge_frac first_hop_lag_s unique_author_ratio max_author_share prior_author_mean prior_author_frac prior_author_p75 prior_author_frac_ge3
 coauthor_linked_frac coauthor_overlap_max structural_virality root_attach_mle""".split()


def _all_features() -> str:
    parts = [f"({_unrounded(name)}) f{k}" for k, name in enumerate(_FAMILIES)]
    columns = ", ".join([f"coalesce({c}, 0)::BIGINT AS {c}" for c in _WHOLE] + [f"round(coalesce({c}, 0), 3) AS {c}" for c in _SHARES])
    return f"SELECT root_id, {columns} FROM {parts[0]}" + "".join(f" LEFT JOIN {p} USING (root_id)" for p in parts[1:])


@query()
def c4_rounded_features(spark, sf):
    """All 37 features of every cascade, to three places."""
    from .queries import c4_all_features

    return c4_all_features(spark, sf).transform(lambda d: _r(d, 3))


ORACLE_SQL["c4_rounded_features"] = _all_features()


@query("SELECT cascade, max(k) AS peak FROM (SELECT cascade, count(*) OVER (PARTITION BY cascade ORDER BY t RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS k FROM p) GROUP BY 1")
def w3_peaks_a_minute(spark, sf):
    w = Window.partitionBy("cascade").orderBy("t").rangeBetween(0, 60)
    return posts(spark, sf).withColumn("n", F.count("*").over(w)).groupBy("cascade").agg(F.max("n").alias("peak"))


@query(
    """, hi AS (SELECT entity_id, arrival, n_events, list_sort(list(n_events) OVER (PARTITION BY entity_id ORDER BY arrival ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) AS c FROM v),
 hh AS (SELECT *, greatest(1, (4 * len(c) + 4) // 5) AS keep, c[least(len(c), 9 * len(c) // 10 + 1)] AS top FROM hi WHERE len(c) >= 5), ra AS (SELECT *, (list_sum(c[1:keep]) + 0.5::DOUBLE) / (keep + 1) AS rate, list_transform(c, lambda x: least(x, top)) AS w FROM hh),
 sh AS (SELECT *, CASE WHEN greatest(list_var_samp(w), rate) > rate * (1 + 1e-9) THEN rate * rate / (greatest(list_var_samp(w), rate) - rate) END AS shape FROM ra)
 SELECT entity_id, arrival, round(rate, 6) AS rate, round(CASE WHEN shape IS NULL THEN 1 - (SELECT coalesce(sum(exp(i * ln(rate) - rate - lgamma(i + 1))), 0) FROM range(0, n_events) g(i))
  ELSE 1 - (SELECT coalesce(sum(exp(lgamma(i + shape) - lgamma(shape) - lgamma(i + 1) + shape * ln(shape / (shape + rate)) + i * ln(rate / (shape + rate)))), 0) FROM range(0, n_events) g(i)) END, 6) AS tail FROM sh"""
)
def b5_negbin_tails(spark, sf):
    """How unlikely each count is under a negative binomial of the sixty before it, or a Poisson where they are not overdispersed."""
    return A.negbin_tails(A.velocity(A.mentions(graph(spark, sf).edges))).drop("shape").transform(_r)
