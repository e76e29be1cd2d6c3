"""Windows in slices and doubled steps against plain loops, with hot topics, cycles and joins."""

import math
import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplemill.operators import graph, running, velocity
from ripplemill.functions.scalars import short_code, strip_nul


def mentions(n, hot=0.8, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < hot else f"e{rng.randrange(4)}", float(rng.randrange(4000)), i) for i in range(n)]


def test_windows_in_slices_see_the_same(spark):
    rows = mentions(900)
    df = spark.createDataFrame(rows, "entity_id string, t double, arrival long").repartition(3)
    for back, n in ((3, 7), (60, 61), (5, 10_000)):
        dealt, own, by = running.by_rows(df, ["entity_id"], "arrival", back, n)
        w = Window.partitionBy(*by).orderBy("arrival").rowsBetween(-back, -1)
        got = {(r.entity_id, r.arrival): r.h for r in dealt.withColumn("h", F.collect_list("t").over(w)).where(own).collect()}
        assert len(got) == len(rows)
        for e in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == e]
            for k, r in enumerate(mine):
                assert got[e, r[2]] == [x[1] for x in mine[max(0, k - back) : k]]
    for windows in (1, 3, 1000):
        dealt, own, by = running.by_time(df, ["entity_id"], "t", 50, windows)
        w = Window.partitionBy(*by).orderBy("t").rangeBetween(-50, 0)
        got = {r.arrival: r.n for r in dealt.withColumn("n", F.count("*").over(w)).where(own).collect()}
        assert got == {i: sum(e == x and t - 50 <= u <= t for x, u, _ in rows) for e, t, i in rows}


def test_tails_of_both_distributions(spark):
    """Columns against the state that walks a topic."""
    rows = sorted(mentions(400, 0.9, 4), key=lambda r: r[1])
    rows = [(e, t, i) for i, (e, t, _) in enumerate(rows)]
    v = velocity.velocity(spark.createDataFrame(rows, "entity_id string, t double, arrival long"), 200.0)
    counts = {(r.entity_id, r.arrival): (r.velocity, r.n_events) for r in v.collect()}
    poisson = {(r.entity_id, r.arrival): r for r in velocity.poisson_tails(v).collect()}
    negbin = {(r.entity_id, r.arrival): r for r in velocity.negbin_tails(v).collect()}
    shapes = 0
    for e in {r[0] for r in rows}:
        b = velocity.Baseline(math.inf)
        for key in sorted(k for k in counts if k[0] == e):
            if len(b.n) >= 5:
                rate, shape = b.rate()
                n = counts[key][1]
                assert poisson[key].rate == pytest.approx(rate) and negbin[key].shape == (None if shape is None else pytest.approx(shape))
                assert poisson[key].tail == pytest.approx(math.exp(velocity.log_tail(n, rate, None)), abs=1e-9)
                assert negbin[key].tail == pytest.approx(math.exp(velocity.log_tail(n, rate, shape)), abs=1e-9)
                shapes += shape is not None
            else:
                assert key not in poisson
            b.step(*counts[key])
    assert shapes > 20


def forest(seed, sizes):
    """Trees of which one has most of the posts, and a very deep one."""
    rng = random.Random(seed)
    pairs = []
    for k, n in enumerate(sizes):
        for i in range(1, n):
            parent = 0 if rng.random() < 0.3 else rng.randrange(i)
            pairs.append((f"r{k}:{parent}", f"r{k}:{i}"))
    return pairs + [(f"deep:{i}", f"deep:{i + 1}") for i in range(50)]


def test_descents_and_sizes_of_subtrees(spark):
    pairs = forest(2, [400, 3, 2, 9])
    edges = spark.createDataFrame([(a, b, "reshare", "p", 0, float(i)) for i, (a, b) in enumerate(pairs)], "source_id string, target_id string, edge_type string, platform string, ts int, t double")
    roots = graph.cascade_roots(edges)
    for depth in (1, 5, 40, 64):
        want, level = [], [(r, r) for r in ("r0:0", "r1:0", "r2:0", "r3:0", "deep:0")]
        for d in range(depth + 1):
            want += [(r, x, d) for r, x in level]
            level = [(r, b) for r, x in level for a, b in pairs if a == x]
        assert sorted(map(tuple, graph.descents(edges, roots, depth).collect())) == sorted(want)
    tree = graph.reshare_trees(edges, roots)
    assert tree.count() == sum(1 for a, _ in pairs if not a.startswith("deep") or int(a[5:]) < 40)
    sizes = {(r.root_id, r.node): r.s for r in graph.subtree_sizes(tree).collect()}
    below = {}
    for a, b in sorted(pairs[:-50], key=lambda p: -int(p[1].split(":")[1])):
        below[b] = below.get(b, 1)
        below[a] = below.get(a, 1) + below[b]
    assert {n: s for (r, n), s in sizes.items() if r != "deep:0"} == below and sizes["deep:0", "deep:0"] == 41
    v = {r.root_id: r.structural_virality for r in graph.structural_virality(tree).collect()}
    assert v["r2:0"] == 1.0
    nodes = sorted({x for p in pairs for x in p if x.startswith("r3")})
    near = {(a, b): 0 if a == b else 1 if (a, b) in pairs or (b, a) in pairs else math.inf for a in nodes for b in nodes}
    for k in nodes:
        for a in nodes:
            for b in nodes:
                near[a, b] = min(near[a, b], near[a, k] + near[k, b])
    assert v["r3:0"] == pytest.approx(sum(near.values()) / (len(nodes) * (len(nodes) - 1)))


def test_paths_of_joins_and_cycles(spark):
    pairs = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("e", "r")]
    edges = spark.createDataFrame(pairs, "source_id string, target_id string")
    roots = spark.createDataFrame([("r",)], "root_id string")
    want, level = [], ["r"]
    for d in range(8):
        want += [("r", x, d) for x in level]
        level = [b for x in level for a, b in pairs if a == x]
    assert sorted(map(tuple, graph.descents(edges, roots, 7).collect())) == sorted(want)
    for depth, n in ((1, 2), (2, 3), (4, 5), (10, 6)):  # the root too, once the cycle has come back to it
        assert graph.cascade_size(edges, "r", depth).first()["size"] == n
    up = {tuple(r) for r in graph.above(edges, spark.createDataFrame([("c",)], "node string"), 2).collect()}
    assert up == {("a", "c"), ("b", "c"), ("d", "c"), ("r", "a"), ("r", "b"), ("c", "d")}
    assert graph.above(edges, spark.createDataFrame([("nowhere",)], "node string"), 5).isEmpty()


def test_codes_and_nul_in_every_part(spark):
    df = spark.createDataFrame([("Bluesky",), ("MDN",), ("linkedin",), ("x",), (None,)], "p string")
    assert [r[0] for r in df.select(short_code(F.col("p"))).collect()] == ["bsky", "mdn", "link", "x", None]
    deep = "s struct<a: string, b: array<struct<c: string>>, m: map<string, array<string>>, n: int>"
    rows = spark.createDataFrame([((("\x00a", [("b\x00",), None], {"k\x00": ["\x00"], "k": ["later"]}, 3)),), (None,)], deep)
    got = rows.select(strip_nul(F.col("s"), rows.schema["s"].dataType).alias("s")).collect()
    assert got[0].s.a == "a" and got[0].s.b[0].c == "b" and got[0].s.b[1] is None and got[0].s.m in ({"k": ["later"]}, {"k": [""]}) and got[0].s.n == 3 and got[1].s is None
