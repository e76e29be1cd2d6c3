"""Ties, large counts, long topics and many vectors: what failed on larger tables."""

import math
import random
import statistics
from decimal import Decimal, localcontext

import numpy as np
import pytest

from pyspark.sql import functions as F

from ripplemill.functions import scalars, tails
from ripplemill.operators import running, search, velocity, versioned


def test_rates_of_events_at_one_time(spark, tmp_path):
    """Between events at one time a rate is no number, not an error; elsewhere by 0 an infinity."""
    import datetime as dt

    import __spark_entry__ as entry

    at = dt.datetime(2026, 1, 1)
    rows = [(i, at + dt.timedelta(seconds=s), 1, e, v, "{}") for i, (e, s, v) in enumerate([("a", 0, 1.0), ("a", 0, 1.0), ("a", 2, 3.0), ("b", 0, 1.0), ("b", 4, 3.0)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_type: (r.rate, r.most) for r in entry.queries()["a18_w8_rates"](spark, str(tmp_path)).collect()}
    assert math.isnan(got["a"][0]) and got["a"][1] == 2.0 and got["b"] == (0.5, 4.0)
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (3.0, 2.0)], "a double, b double")
    one, two, three, four, five = (r.x for r in df.select(scalars.ratio(F.col("a"), F.col("b")).alias("x")).collect())
    assert (one, two, four, five) == (math.inf, -math.inf, None, 1.5) and math.isnan(three)


def exact_tail(k, mean, shape):
    """P(X >= k) by adding up 300 digits."""
    with localcontext() as c:
        c.prec = 300
        m, s = Decimal(mean), None if shape is None else Decimal(shape)
        p, below = (-m).exp() if s is None else ((s / (s + m)).ln() * s).exp(), Decimal(0)
        for i in range(k):
            below += p
            p *= m / (i + 1) if s is None else (s + i) / (i + 1) * (m / (s + m))
        return float(1 - below)


def test_tails_of_large_counts():
    """exp(-mean) is 0 beyond 745: a sum from there is 0 too."""
    cases = [(k, k * f, s) for k in (1, 4, 60, 900, 2500) for f in (0.5, 0.97, 1.0, 1.2) for s in (None, 0.4, 8.0, 60.0, 3000.0, 1e12)]
    got = np.exp(tails.log_tails([c[0] for c in cases], [c[1] for c in cases], [math.nan if c[2] is None else c[2] for c in cases]))
    for c, x in zip(cases, got):
        assert x == pytest.approx(exact_tail(*c), rel=1e-10, abs=1e-200), c
    assert tails.log_tails([0, -3], [5.0, 5.0]).tolist() == [0.0, 0.0]


def test_tails_of_busy_topics(spark):
    rng = random.Random(3)
    counts = [rng.randrange(1500, 2100) for _ in range(90)]
    v = spark.createDataFrame([("hot", i, n) for i, n in enumerate(counts)], "entity_id string, arrival long, n_events long")
    poisson, negbin = ({r.arrival: r for r in f(v).collect()} for f in (velocity.poisson_tails, velocity.negbin_tails))
    assert set(poisson) == set(negbin) == set(range(5, 90))
    for i in range(5, 90):
        h = sorted(counts[max(0, i - 60) : i])
        quiet = h[: (4 * len(h) + 4) // 5]
        rate = (sum(quiet) + 0.5) / (len(quiet) + 1)
        w = [min(x, h[min(len(h) - 1, 9 * len(h) // 10)]) for x in h]
        var = max(statistics.variance(w), rate)
        assert poisson[i].rate == rate and poisson[i].tail == pytest.approx(exact_tail(counts[i], rate, None), abs=1e-10)
        assert negbin[i].shape == pytest.approx(rate * rate / (var - rate)) and negbin[i].tail == pytest.approx(exact_tail(counts[i], rate, rate * rate / (var - rate)), abs=1e-10)
    column = spark.createDataFrame([(2000,), (3,), (0,), (None,)], "n long").select(scalars.poisson_tail(F.col("n"), F.lit(1990.0)).alias("x"))
    assert [r.x for r in column.collect()] == [pytest.approx(exact_tail(2000, 1990, None), abs=1e-10), 1.0, 1.0, None]


def test_scores_over_slices_and_batches(spark, monkeypatch):
    """Topics longer than a slice and than a batch, against the state that walks each topic."""
    monkeypatch.setattr("ripplemill.operators.history.by_rows", lambda *a: running.by_rows(*a, 70))
    rng = random.Random(5)
    rows, at = [], {"a": 0, "b": 0}
    for i in range(900):
        e = rng.choice("aab")
        n = 4 if 300 < i < 520 else rng.randrange(1, 40)
        rows.append((e, i, round(n / 60, 4), n))
    v = spark.createDataFrame(rows, "entity_id string, arrival long, velocity double, n_events long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {(r.entity_id, r.arrival): (r.ewma, r.poisson, r.negbin, r.cusum, r.fired) for r in velocity.sequential_scores(v, 3.0).collect()}
        ewma = {(r.entity_id, r.arrival): r.ewma for r in velocity.ewma_scores(v).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    states = {e: velocity.Baseline(3.0) for e in at}
    assert len(got) == len(ewma) == len(rows)
    for e, i, x, n in rows:
        want = states[e].step(x, n)
        assert got[e, i] == (want[0], *(None if y is None else pytest.approx(y, abs=1.5e-4) for y in want[1:4]), want[4]) and ewma[e, i] == want[0]


def test_nearest_by_blocks(spark, monkeypatch):
    """Blocks of few rows against all pairs: ties, copies, an id under two labels, nulls and vectors of another length."""
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    rng = random.Random(7)
    rows = [(i, [float(rng.randrange(-3, 4)) + (x == 0) * 0.5 for x in range(4)], i % 2) for i in range(60)]
    rows += [(60, rows[4][1], 0), (62, rows[4][1], 0), (4, [1.0, 0.5, 0.25, 1.0], 1), (64, None, 0), (66, [1.0, 2.0], 0), (68, [1.0, None, 0.0, 0.0], 0), (70, [1.0, 1.0, 1.0, 1.0], None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    q = v.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        dot = lambda x, y: sum(p * r for p, r in zip(x, y))
        return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))

    for k in (3, 40):
        want = set()
        asked = [r for r in rows if r[0] % 4 == 0 and r[2] is not None]
        for i in {r[0] for r in asked}:
            met = [(j, cosine(x, y)) for _, x, a in (r for r in asked if r[0] == i) for j, y, b in rows if a == b and j != i]
            met.sort(key=lambda r: (r[1] is None, -round(r[1] or 0.0, 9), r[0]))
            want |= {(i, j, r + 1) for r, (j, _) in enumerate(met[:k])}
        assert {(r.query_id, r.vec_id, r["rank"]) for r in search.top_k(v, q, k).collect()} == want
    plain = v.where("vec_id < 60").withColumnRenamed("label", "version")
    got = versioned.exact(plain, q.where("query_id < 60 AND query_id > 4").withColumnRenamed("label", "version"), 3)
    near = search.top_k(v.where("vec_id < 60"), q.where("query_id < 60 AND query_id > 4"), 3)
    assert {tuple(r) for r in got.select("query_id", "vec_id", "rank").collect()} == {tuple(r) for r in near.select("query_id", "vec_id", "rank").collect()}
