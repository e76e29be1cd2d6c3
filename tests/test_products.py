"""Searches by buckets and by cells as products of blocks: what they find, and that pairs are not made one by one."""

import random

from pyspark.sql import functions as F

from ripplemill.operators import search, versioned


def close_vectors(spark, n, versions=2, seed=5):
    """Vectors around few middles, with ties and copies, so that a bucket or a cell holds many."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(3)]
    rows = [(i, [float(round(x + rng.gauss(0, 0.2), 1)) for x in middles[i % 3]], i % versions) for i in range(n)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return rows, v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")


def compared_in_full(monkeypatch, module):
    """Numbers of pairs that reach the exact comparison."""
    seen, plain = [], search.ranked

    def ranked(pairs, *rest):
        seen.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(module, "ranked", ranked)
    return seen


def test_pairs_within_buckets(spark, monkeypatch):
    """A pair meets in several buckets, or in none."""
    monkeypatch.setattr(search, "BLOCK", 9)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    rows, v, q = close_vectors(spark, 240)
    buckets = lambda c: F.posexplode(F.array(F.col(c) % 2 + 7, F.floor(F.col(c) / 80), F.col(c) % 5)).alias("table", "bucket")
    near = search.nearest_pairs(v.select("*", buckets("vec_id")), q.select("*", buckets("query_id")), 4, ["label"], ["table", "bucket"])
    got = {(r.query_id, r.vec_id, r["rank"]) for r in search.ranked(near, v, q, 4, ["label"]).collect()}
    same = {(r.query_id, r.vec_id): r.s for r in v.join(q, "label").select("query_id", "vec_id", F.round(search.cosine(F.col("q"), F.col("embedding")), 9).alias("s")).collect()}
    want = set()
    for i in range(0, 240, 20):
        met = [j for j, _, a in rows if j != i and a == i % 2 and (i % 2 == j % 2 or i // 80 == j // 80 or i % 5 == j % 5)]
        met.sort(key=lambda j: (-same[i, j], j))
        want |= {(i, j, r + 1) for r, j in enumerate(met[:4])}
    assert got == want


def test_buckets_do_not_make_pairs(spark, monkeypatch):
    rows, v, q = close_vectors(spark, 1200)
    seen = compared_in_full(monkeypatch, search)
    got = search.approximate(v, q, 3).collect()
    assert len(got) == 3 * 60
    # all of a bucket would be hundreds a query
    assert seen and seen[0] < 20 * 60
    exact = {(r.query_id, r.vec_id) for r in search.top_k(v, q, 3).collect()}
    assert len({(r.query_id, r.vec_id) for r in got} & exact) >= 0.9 * len(exact)


def test_cells_do_not_make_pairs(spark, monkeypatch):
    rows, v, q = close_vectors(spark, 900, 3)
    v, q = v.withColumnRenamed("label", "version"), q.withColumnRenamed("label", "version")
    index = versioned.VersionedIndex.build(v)
    # a cell is written by one task, however many tasks there are
    assert index.table().select(F.input_file_name().alias("f")).distinct().count() == index.table().select("version", "cell").distinct().count()
    seen = compared_in_full(monkeypatch, versioned)
    for probes in (3, versioned.MOST_CELLS):
        all_ = index.candidates(q, probes).collect()
        assert index.compared(q, probes) == len(all_)
        for among in (None, v.where("vec_id % 4 = 1").select("vec_id")):
            want = set()
            for i in {r.query_id for r in all_}:
                mine = sorted((-r.similarity, r.vec_id) for r in all_ if r.query_id == i and (among is None or r.vec_id % 4 == 1))
                want |= {(i, j, -s, k + 1) for k, (s, j) in enumerate(mine[:4])}
            assert {tuple(r) for r in index.search(q, 4, probes, among).select("query_id", "vec_id", "similarity", "rank").collect()} == want
    assert len(seen) == 4 and max(seen) < 45 * 20
