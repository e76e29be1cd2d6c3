"""Velocity as of any time, warm-up by partition, and graphs of posts against plain loops, with hot topics and giant cascades."""

import bisect
import math
import random

import pytest

from ripplemill.operators import asof, running, tensors
from pyspark.sql import functions as F


class PlainWindows:
    """A sorted list a topic; recording and asking both evict."""

    def __init__(self, window):
        self.window, self.held, self.floor = window, {}, {}

    def step(self, entity, t, record):
        held = self.held.setdefault(entity, [])
        if record:
            bisect.insort(held, t)
        floor = max(self.floor.get(entity, -math.inf), (held[-1] if record else t) - self.window, t - self.window)
        self.floor[entity] = floor
        while held and held[0] < floor:
            held.pop(0)
        return len(held)


def steps(seed, n, hot):
    rng = random.Random(seed)
    mentions, asked = [], []
    for i in range(n):
        e = "hot" if rng.random() < hot else f"e{rng.randrange(6)}"
        t = float(i * 3 + rng.choice([0, 0, 0, -40, 25, -400]))
        mentions.append((e, t, i))
        if rng.random() < 0.4:
            asked.append((e, t + rng.choice([0, 10, 90, -30, 600]), i))
    asked += [("never", 5.0, 3), ("hot", 1.0, 0)]
    return mentions, asked


@pytest.mark.parametrize("hot,slice_rows", [(0.3, 100_000), (0.9, 50)])
def test_velocity_at_any_time(spark, hot, slice_rows):
    mentions, asked = steps(5, 1500, hot)
    plain, want = PlainWindows(100.0), []
    order = sorted([(a, 0, e, t) for e, t, a in mentions] + [(a, 1, e, t) for e, t, a in asked])
    for a, q, e, t in order:
        want.append((e, a, bool(q), plain.step(e, t, not q)))
    m = spark.createDataFrame(mentions, "entity_id string, t double, arrival long").repartition(3)
    a = spark.createDataFrame(asked, "entity_id string, at double, arrival long")
    got = asof.velocity_at(m, a, 100.0, slice_rows).collect()
    assert sorted((r.entity_id, r.arrival, r.asked, r.n_events) for r in got) == sorted(want)
    assert all(r.velocity == round(r.n_events / (100 / 60), 4) for r in got)
    assert asof.velocity_at(m.where("false"), a, 100.0).where("n_events <> 0").isEmpty()


def test_known_velocities(spark):
    m = spark.createDataFrame([("a", 100.0, 1), ("a", 150.0, 2), ("a", 120.0, 3), ("a", 185.0, 4), *(("b", float(k), 10 + k) for k in range(10))], "entity_id string, t double, arrival long")
    got = {(r.entity_id, r.arrival): r.n_events for r in asof.velocity_at(m, None, 60.0).collect()}
    assert (got[("a", 3)], got[("a", 4)]) == (3, 2)
    ten = asof.velocity_at(m, None, 300.0).where("entity_id = 'b' AND arrival = 19").first()
    assert (ten.n_events, ten.velocity) == (10, 2.0)


@pytest.mark.parametrize("slice_rows", [7, 100_000])
def test_warm_up_restarts(spark, slice_rows):
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, 1, None]), 1000.0 + 5 * i + rng.choice([0, -20]), i, f"e{i % 4}") for i in range(400)]
    resets = [(0, 60), (1, 100), (0, 200), (0, 200), (9, 5), (None, 300)]
    since, want = {}, []
    for p, t, i, e in rows:
        for q, a in resets:
            if q == p and a == i:
                since.pop(p, None)
        # a restart counts from the next mention on its partition, whenever that comes
        for q, a in resets:
            if q == p and a < i and not any(x[0] == p and a <= x[2] < i for x in rows):
                since.pop(p, None)
        since.setdefault(p, t)
        want.append((i, since[p], t - since[p] >= 60.0))
    m = spark.createDataFrame(rows, "partition_id int, t double, arrival long, entity_id string")
    got = asof.warm_by_partition(m, spark.createDataFrame(resets, "partition_id int, arrival long"), 60.0, slice_rows).collect()
    assert sorted((r.arrival, r.since, r.warm) for r in got) == sorted(want)
    known = spark.createDataFrame([(0, 1000.0, 1), (0, 1061.0, 2), (0, 1062.0, 4)], "partition_id int, t double, arrival long")
    warm = {r.t: r.warm for r in asof.warm_by_partition(known, spark.createDataFrame([(0, 3)], "partition_id int, arrival long"), 60.0).collect()}
    assert warm == {1000.0: False, 1061.0: True, 1062.0: False}


def test_running_values(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(-50, 200), rng.choice([None, 1, 5, -3])) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    for how, plain in ((F.sum, lambda x: sum(x)), (F.max, lambda x: max(x, default=None)), (F.min, lambda x: min(x, default=None))):
        want = [(k, o, v, plain([y for a, b, y in rows if a == k and b <= o and y is not None])) for k, o, v in rows]
        for steps_ in (9, 10_000):
            got = running.running(df, ["k"], "o", F.col("v"), how, "x", steps_).collect()
            assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def cascade(n_big, seed=3):
    """A giant star with chains on it, beside small cascades of the same authors."""
    rng = random.Random(seed)
    tree, authors = [], []
    for root, n, start in (("big", n_big, 5000.0), ("early", 5, 1000.0), ("late", 6, 20000.0)):
        authors.append((root, root, "u1", start, "x"))
        for i in range(n):
            parent = root if i < 3 or rng.random() < 0.7 else f"{root}:{rng.randrange(i)}"
            tree.append((root, parent, f"{root}:{i}", start + 1 + i // 2, rng.choice("xy")))
            if rng.random() < 0.95:
                authors.append((root, f"{root}:{i}", f"u{rng.randrange(40)}", start + 1 + i // 2, "x"))
    depth = {r: 0 for r in ("big", "early", "late")}
    out = []
    for r, p, c, t, q in tree:
        depth[c] = depth[p] + 1
        out.append((r, p, c, t, q, depth[c]))
    return out, authors


def plain_posts(tree, authors):
    starts = {}
    for r, _, _, t, _, _ in tree:
        starts[r] = min(starts.get(r, math.inf), t)
    wrote = {c: a for _, c, a, _, _ in authors}
    who = {r: {a for x, _, a, _, _ in authors if x == r} for r in starts}
    out = {}
    for root, start in starts.items():
        prior = [r for r, s in starts.items() if (s, r) < (start, root) and s >= start - 21600]
        own = [x for x in tree if x[0] == root]
        seed = [(t, q) for x, c, _, t, q in authors if c == root and x == root]
        t0, q0 = min(seed) if seed else min((x[3], x[2], x[4]) for x in own)[::2]
        nodes = [(root, None, t0, q0, 0), *sorted(((c, p, t, q, d) for _, p, c, t, q, d in own), key=lambda x: (x[2], x[0]))]
        at, platform, seen = {x[0]: x[2] for x in nodes}, {x[0]: x[3] for x in nodes}, set()
        for place, (c, p, t, q, d) in enumerate(nodes):
            a = wrote.get(c)
            x = [float(p is None), d / 5, math.log1p(max(t - at[p], 0) if p else 0) / 5, math.log1p(max(t - t0, 0)) / 5, float(p is not None and platform[p] != q)]
            x += [math.log1p(sum(y[1] == c for y in own)), math.log1p(sum(a in who[r] for r in prior)) if a else 0.0, float(a is not None and a in seen)]
            seen.add(a)
            out[root, c] = (place, x)
    return out


def test_post_inputs_and_messages(spark):
    tree, authors = cascade(700)
    want = plain_posts(tree, authors)
    t = spark.createDataFrame(tree, "root_id string, source_id string, target_id string, t double, platform string, depth int").repartition(4)
    a = spark.createDataFrame(authors, "root_id string, content_id string, author_id string, t double, platform string")
    posts, edges = tensors.graphs(t, a)
    got = {(r.root_id, r.post_id): (r.place, [r[c] for c in tensors.INPUTS]) for r in posts.collect()}
    assert got.keys() == want.keys()
    for k, (place, x) in want.items():
        assert got[k][0] == place and got[k][1] == pytest.approx(x)
    pairs = {(r, want[r, p][0], want[r, c][0]) for r, p, c, *_ in tree}
    assert {tuple(e) for e in edges.collect()} == pairs
    now = {(r, place): x for (r, _), (place, x) in want.items()}
    wide = {r.root_id: r for r in tensors.pooled(posts, edges, 2).collect()}
    for layer in range(3):
        for root in ("big", "early", "late"):
            each = [x for (r, _), x in now.items() if r == root]
            for j, c in enumerate(tensors.INPUTS):
                assert wide[root][f"{c}_mean_{layer}"] == pytest.approx(sum(x[j] for x in each) / len(each))
                assert wide[root][f"{c}_max_{layer}"] == pytest.approx(max(x[j] for x in each))
            assert wide[root].log_size == pytest.approx(math.log(len(each)))
        after = {k: list(x) for k, x in now.items()}
        for r, p, c in pairs:
            for j in range(8):
                after[r, c][j] += now[r, p][j]
                after[r, p][j] += now[r, c][j]
        now = after
