"""Detectors, gates, versioned search and nested folds against plain loops."""

import math
import random
import re

import numpy as np
import pytest

from ripplemill.operators import deferral, detectors, learning, versioned
from ripplemill.operators.velocity import Baseline
from pyspark.sql import functions as F


def stream(seed, n, hot=0.7):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        t += rng.expovariate(1 / 8) if not 300 < i % 500 < 360 else 0.5
        rows.append(("hot" if rng.random() < hot else f"e{rng.randrange(3)}", t, i))
    return [*rows, ("single", 5.0, n)]


def plain_alarms(rows, window, grids):
    """Each topic walked by itself, once for every detector and threshold."""
    out = []
    for e in {r[0] for r in rows}:
        times = [t for x, t, _ in rows if x == e]
        if len(times) < 2:
            continue
        samples = [(t, sum(t - window <= u <= t for u in times)) for t in times]
        for d, grid in grids.items():
            for h in grid:
                b, s, hist = Baseline(math.inf), 0.0, []
                for t, n in samples:
                    v = round(n / (window / 60), 4)
                    past = hist[-60:]
                    b.step(v, n)
                    z = None
                    if d in ("zscore", "robust") and len(past) >= 5:
                        mid = np.mean(past) if d == "zscore" else np.median(past)
                        spread = np.std(past) if d == "zscore" else 1.4826 * np.median(np.abs(np.array(past) - mid))
                        z = (v - mid) / spread if spread > 1e-12 else None
                    elif d in ("ewma", "poisson", "negbin"):
                        z = b.exact[("ewma", "poisson", "negbin").index(d)]
                    elif d == "cusum" and b.exact[1] is not None:
                        s = max(0.0, s + b.exact[1] - 0.5)
                        z, s = s, 0.0 if s >= h else s
                    if z is not None and z >= h - 1e-11:
                        out.append((d, h, e, t))
                    hist.append(v)
    return sorted(out)


GRIDS = {"zscore": [2.0, 3.0], "robust": [2.5, 4.0], "ewma": [2.0, 3.0], "poisson": [2.0, 3.0], "negbin": [2.0, 2.5], "cusum": [2.0, 5.0, 12.0]}


def test_alarms_of_six_detectors(spark):
    rows = stream(3, 900)
    m = spark.createDataFrame(rows, "entity_id string, t double, arrival long").repartition(3)
    got = sorted((r.detector, r.threshold, r.entity_id, r.t) for r in detectors.alarms(detectors.per_event(m, 120.0), GRIDS).collect())
    want = plain_alarms(rows, 120.0, GRIDS)
    assert {d for d, *_ in want} == set(GRIDS) and got == want


def plain_card(alarms, onsets, hours, point):
    mine = [(e, t) for d, h, e, t in alarms if (d, h) == point and e in hours]
    o = [x for x in onsets if x[0] in hours]
    hit, delays = {"coordinated": 0, "organic": 0}, []
    for e, at, label in o:
        after = [t for x, t in mine if x == e and at <= t <= at + 3600]
        if after:
            hit[label] += 1
            delays += [min(after) - at] if label == "coordinated" else []
    explained = sum(any(x == e and at <= t <= at + 3600 for x, at, _ in o) for e, t in mine)
    false, n = len(mine) - explained, {k: sum(x[2] == k for x in o) for k in hit}
    share = lambda a, b: a / b if b else 0.0
    return (*point, len(mine), share(hit["coordinated"], n["coordinated"]), share(hit["organic"], n["organic"]), share(false, len(mine)), share(24 * false, sum(hours.values())), float(np.median(delays)) / 60 if delays else None)


def test_cards_and_choice(spark):
    rng = random.Random(8)
    topics = [f"t{k}" for k in range(6)]
    hours = {e: rng.uniform(5, 50) for e in topics[:5]}
    onsets = [(rng.choice(topics), float(rng.randrange(200_000)), rng.choice(["coordinated", "organic"])) for _ in range(60)]
    onsets += onsets[:3]
    points = [("robust", 2.5), ("robust", 4.0), ("zscore", 2.0), ("zscore", 3.0), ("never", 1.0)]
    alarms = []
    for d, h in points[:4]:
        for _ in range(int(400 / h)):
            e, at, _ = rng.choice(onsets)
            alarms.append((d, h, e, at + rng.uniform(-2000, 6000)) if rng.random() < 0.5 else (d, h, rng.choice(topics), rng.uniform(0, 200_000)))
    alarms += alarms[:5]
    df = spark.createDataFrame(alarms, "detector string, threshold double, entity_id string, t double")
    cards = detectors.cards(df, spark.createDataFrame(onsets, "entity_id string, onset double, label string"), spark.createDataFrame(list(hours.items()), "entity_id string, hours double"), spark.createDataFrame(points, "detector string, threshold double"))
    got = {(r.detector, r.threshold): tuple(r) for r in cards.collect()}
    want = {p: plain_card(alarms, onsets, hours, p) for p in points}
    assert got.keys() == want.keys()
    for p in points:
        assert got[p][:3] == want[p][:3] and got[p][3:] == pytest.approx(want[p][3:])
    front = {(r.detector, r.threshold): r.pareto for r in detectors.with_front(cards).collect()}
    fr = {p: (w[6], w[3]) for p, w in want.items()}
    assert front == {p: not any(b[0] <= a[0] and b[1] >= a[1] and b != a for b in fr.values()) for p, a in fr.items()}
    target = want[("robust", 2.5)][3]
    best = {}
    for d in ("robust", "zscore"):
        ok = [(w[6], -w[3], p[1]) for p, w in want.items() if p[0] == d and w[3] >= target]
        if ok:
            best[d] = min(ok)[2]
    assert {r.detector: r.threshold for r in detectors.chosen(cards).collect()} == best


def test_gates(spark):
    rng = random.Random(5)
    rows = [(rng.random(), rng.uniform(0.5, 1), int(rng.random() < 0.7)) for _ in range(400)]
    rows = [(q, c, int(g or q > 0.8)) for q, c, g in rows]
    df = spark.createDataFrame(rows, "p_correct double, confidence double, correct int").repartition(3)

    def curve(k):
        out = []
        for g in deferral.GATES:
            keep = [r for r in rows if r[k] >= g]
            if keep:
                out.append((g, len(keep) / len(rows), sum(r[2] for r in keep) / len(keep), len(keep)))
        return out

    got = sorted(map(tuple, deferral.gate_curve(df, "p_correct").collect()))
    assert [x[0] for x in got] == [x[0] for x in curve(0)]
    for a, b in zip(got, curve(0)):
        assert a == pytest.approx(b)
    chosen = {r.target: r for r in deferral.compare_gates(df, [0.8, 0.9, 0.999]).collect()}
    for target in (0.8, 0.9, 0.999):
        wide = [x for x in curve(0) if x[1] >= 0.25]
        ok = [x for x in wide if x[2] >= target]
        best = min(ok, key=lambda x: (-x[1], x[0])) if ok else min(wide, key=lambda x: (-x[2], -x[0]))
        other = min(curve(1), key=lambda x: (abs(x[1] - best[1]), x[0]))
        r = chosen[target]
        assert (r.threshold, r.accuracy, r.coverage, r.other_threshold, r.other_accuracy) == pytest.approx((best[0], best[2], best[1], other[0], other[2]))


def learnable(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, hard = rng.random(), rng.random(), rng.random() < 0.3
        y = float(rng.random() < 0.5) if hard else float(a > 0.5)
        rows.append((i, y, a, b, float(hard)))
    return spark.createDataFrame(rows, "row_id long, y double, a double, b double, c double")


def test_deferral_learns_what_is_hard(spark):
    """Where difficulty shows in a feature, the second model's gate is more accurate than confidence at the same coverage."""
    train, held = learnable(spark, 1, 600), learnable(spark, 2, 400)
    first = learning.trees(["a", "b"], 5)
    second = deferral.fit_deferral(train, ["a", "b", "c"], first, 3, 5)
    scored = deferral.deferred(second, learning.scored(first.fit(train), held))
    r = deferral.compare_gates(scored, [0.95]).first()
    assert r.accuracy > r.other_accuracy and 0.25 <= r.coverage <= 1
    assert scored.where("correct = 1").agg(F.avg("p_correct")).first()[0] > scored.where("correct = 0").agg(F.avg("p_correct")).first()[0]


def test_nested_search_and_skew(spark):
    rows = learnable(spark, 3, 300)
    got = learning.nested_search(rows, ["a", "b"], 3, 2, (1, 3), (2, 6)).orderBy("fold").collect()
    assert [r.fold for r in got] == [0, 1, 2] and all(r.depth in (1, 3) and r.rounds in (2, 6) and r.roc_auc > 0.7 for r in got)
    r = learning.skew(learning.trees(["a", "b"], 5), rows, rows.withColumn("a", F.lit(0.0)), 3).first()
    assert r.auc_in_context > 0.75 and r.auc_alone < 0.65


def clustered(spark, seed=2, n=600, dims=16):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(20, dims))
    rows = [(i, "hot" if i % 3 else f"v{i % 4}", (middle[rng.integers(20)] + 0.2 * rng.normal(size=dims)).tolist()) for i in range(n)]
    rows += [(n + 1, "one", [1.0] * dims), (n + 2, "hot", None), (n + 3, None, [1.0] * dims)]
    return rows, spark.createDataFrame(rows, "vec_id long, version string, embedding array<double>")


def plain_nearest(rows, queries, k):
    out = set()
    for q, v, x in queries:
        near = sorted((-round(float(np.dot(np.float32(x).astype(float), np.float32(y).astype(float)) / np.sqrt(np.dot(np.float32(x).astype(float), np.float32(x).astype(float)) * np.dot(np.float32(y).astype(float), np.float32(y).astype(float)))), 9), i) for i, w, y in rows if w == v and y is not None and i != q)
        out |= {(q, i) for _, i in near[:k]}
    return out


def test_versioned_index(spark):
    rows, v = clustered(spark)
    queries = [(i, w, x) for i, w, x in rows if i % 20 == 0 and x is not None and w is not None]
    q = spark.createDataFrame(queries, "query_id long, version string, q array<double>")
    index = versioned.VersionedIndex.build(v)
    assert index.table().count() == 601
    want = plain_nearest(rows, queries, 5)
    got = {(r.query_id, r.vec_id) for r in index.search(q, 5, versioned.MOST_CELLS).collect()}
    assert got == want
    near = {(r.query_id, r.vec_id) for r in index.search(q, 5, 8).collect()}
    assert len(near & want) >= 0.9 * len(want)
    assert {(r.query_id, r.vec_id) for r in versioned.exact(v, q).collect()} == want
    # other versions and far cells are pruned before they are read
    plan = index.candidates(q.where("version = 'v0'"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*v0", plan) and not re.search(r"PartitionFilters: \[[^\]]*hot", plan)
    known = {i: w for i, w, _ in rows}
    assert all(known[a] == known[b] for a, b in near)
    assert index.search(q.withColumn("version", F.lit("unknown"))).isEmpty()


def test_selectivity_table(spark):
    rows, v = clustered(spark, n=400)
    q = v.where("vec_id % 20 = 0 AND embedding IS NOT NULL").selectExpr("vec_id AS query_id", "embedding AS q")
    got = {(r.selectivity, r.search): r for r in versioned.selectivity(v, q, [0.3], probes=6).collect()}
    assert got[0.3, "own"].recall > got[0.3, "shared"].recall and got[0.3, "own"].read < got[0.3, "shared"].read
    assert got[0.3, "iterative"].recall >= got[0.3, "shared"].recall and got[0.3, "iterative"].returned == got[0.3, "own"].returned == 5
