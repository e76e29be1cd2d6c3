"""Hand-made cases with known answers, and a few queries against an independent engine.

The numbers of the cases are fixed values: inputs and results that any right build must have.
"""

import glob
import math
import os
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from ripplemill.operators import evaluation, features, ingest, search, velocity
from ripplemill.operators.velocity import Baseline, log_tail, upper_z

SF = "/root/testdata/sf0.001"


def tree(spark, rows):
    return spark.createDataFrame([("r", a, b, float(t), "hn", d) for a, b, t, d in rows], "root_id string, source_id string, target_id string, t double, platform string, depth int")


def authors(spark, rows):
    return spark.createDataFrame(rows, "root_id string, content_id string, author_id string, t double, platform string")


def test_star_and_chain(spark):
    star = features.structure(tree(spark, [("r", "a", 60, 1), ("r", "b", 120, 1), ("r", "c", 180, 1)])).first()
    assert (star.size, star.max_depth, star.root_fanout, star.root_fanout_share, star.leaf_frac) == (4, 1, 3, 1.0, 0.75)
    chain = features.structure(tree(spark, [("r", "a", 60, 1), ("a", "b", 120, 2), ("b", "c", 180, 3)])).first()
    assert (chain.max_depth, chain.root_fanout, round(chain.root_fanout_share, 6)) == (3, 1, round(1 / 3, 6))


def test_true_root_time(spark):
    t = features.timing(tree(spark, [("r", "a", 60, 1), ("r", "b", 120, 1)]), authors(spark, [("r", "r", "x", 0.0, "hn")])).first()
    assert (t.delay_median_s, t.duration_s) == (90.0, 120.0)


def test_root_attachment_extremes(spark):
    assert features.root_attachment(tree(spark, [("r", "a", 1, 1), ("r", "b", 2, 1), ("r", "c", 3, 1)])).first().root_attach_mle == 1.0
    assert features.root_attachment(tree(spark, [("r", "a", 1, 1), ("a", "b", 2, 2), ("b", "c", 3, 3)])).first().root_attach_mle == 0.0


def test_velocity_counts(spark):
    m = spark.createDataFrame([("e", "hn", float(i), i) for i in range(10)], "entity_id string, platform string, t double, arrival long")
    last = velocity.velocity(m, 300).orderBy("arrival").collect()[-1]
    assert (last.n_events, last.velocity) == (10, 2.0)


def test_late_event(spark):
    m = spark.createDataFrame([("e", "hn", t, i) for i, t in enumerate((100.0, 150.0, 120.0, 185.0))], "entity_id string, platform string, t double, arrival long")
    n = {r.arrival: r.n_events for r in velocity.late_velocity(m, 60).collect()}
    assert (n[2], n[3]) == (3, 2)


def test_baselines():
    assert abs(upper_z(math.log(0.5))) < 1e-3 and abs(upper_z(math.log(0.02275)) - 2) < 1e-3
    assert abs(log_tail(3, 2.0, None) - math.log(1 - math.exp(-2) * 5)) < 1e-9
    b = Baseline(5.0)
    fired = [b.step(float(n), n)[4] for n in (2, 3, 2, 2, 3, 2, 2, 3, 2, 2, 6, 6, 6, 6, 6)]
    assert not fired[10] and any(fired[11:])


def test_pareto(spark):
    p = spark.createDataFrame([(1.0, 0.8), (3.0, 0.9), (2.0, 0.7), (0.5, 0.6)], "fp double, recall double")
    assert sorted(r.fp for r in evaluation.pareto(p).collect()) == [0.5, 1.0, 3.0]


def test_parse_and_replay(spark):
    raw = spark.createDataFrame([("t", 0, 1, '{"id": "1", "platform": "hn", "type": "story", "author": "a", "title": "Big Tech"}'), ("t", 0, 2, '{"id": "1", "platform": "hn"}'), ("t", 0, 7, "{not json"), ("t", 0, 8, '{"platform": "hn"}')], "topic string, partition int, offset long, value string")
    records, dead = ingest.parse(raw)
    assert [r.offset for r in records.collect()] == [1] and sorted(r.offset for r in dead.collect()) == [7, 8]
    edges = ingest.extract(records).selectExpr("explode(edges) AS e", "offset AS arrival").select("e.*", "arrival")
    once = ingest.merge_edges(edges)
    assert once.count() == 2 and ingest.merge_edges(edges.union(edges)).count() == 2 and ingest.merge_edges(edges, once).count() == 0


def test_stream_and_batch_agree(spark, tmp_path):
    from ripplemill.streaming.pipeline import ingest as start

    raw = spark.createDataFrame([("t", 0, i, f'{{"id": "{i % 5}", "platform": "hn", "author": "a{i % 3}", "title": "x"}}') for i in range(20)], "topic string, partition int, offset long, value string").coalesce(1)
    raw.write.parquet(f"{tmp_path}/raw")
    q = start(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/raw"), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out/edges").count()
    batch = ingest.extract(ingest.parse(raw)[0]).selectExpr("explode(edges) AS e", "offset AS arrival").select("e.*", "arrival")
    assert got == ingest.merge_edges(batch).count() == 5


def test_whole_inputs(spark, tmp_path):
    late = "word " * 100 + "Big Tech"
    d = spark.createDataFrame([(i, late, "en", "s", len(late)) for i in range(6)] + [(6, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    q = {n: f(spark, str(tmp_path)) for n, f in entry.queries().items() if n in ("x2_x5_extract", "p10_plausible_words", "p11_strip_nul_all")}
    assert {r.platform for r in q["x2_x5_extract"].where("edge_type = 'mentions'").collect()} == {"bluesky", "mastodon", "hn"}
    assert {r.doc_id: r.plausible for r in q["p10_plausible_words"].collect()} == {**dict.fromkeys(range(6), 102), 6: 0}
    assert {r.doc_id: r.a for r in q["p11_strip_nul_all"].collect()} == {**dict.fromkeys(range(6), late + "x"), 6: None}
    fired = entry.queries()["j12_fired_attribution"](spark, SF)
    assert fired.count() == entry.queries()["j12_attribution"](spark, SF).count()


def test_bootstrap(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 200)
    p, q = np.round(np.clip(y * 0.3 + rng.random(200) * 0.7, 0, 1), 2), np.round(np.clip(y * 0.1 + rng.random(200) * 0.9, 0, 1), 2)

    def stats(s, i):
        a, h = y[i], s[i] >= 0.5
        pos, neg = s[i][a == 1][:, None], s[i][a == 0][None]
        f1 = [2 * ((h == c) & (a == c)).sum() / ((h == c).sum() + (a == c).sum()) for c in (0, 1)]
        return np.array([((pos > neg) + (pos == neg) / 2).mean(), sum(f1) / 2, (h == a).mean()])

    draws = [rng.integers(0, 200, 200) for _ in range(2000)]
    want = np.array([stats(p, i) - stats(q, i) for i in draws])
    s = spark.createDataFrame([(k, int(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(y, p, q))], "row_id long, y int, p double, q double")
    got = evaluation.bootstrap_gain(s).first()
    assert got.replicates == 2000
    for k, name in enumerate(("auc_", "f1_", "")):
        for c, x in (("gain", want[:, k].mean()), ("low", np.percentile(want[:, k], 2.5)), ("high", np.percentile(want[:, k], 97.5))):
            assert abs(got[name + c] - x) < 0.02


@pytest.mark.parametrize("name", ["o6_temporal_split", "w2_t8_late_velocity"])
def test_sliced_against_sql(spark, name):
    test_against_sql(spark, name)


def test_groups_are_ranked_in_slices(spark):
    rows = [(i, i % 7 // 6 if i % 50 else None, float(i * 37 % 500 // 5) if i % 31 else None) for i in range(3000)]
    s = spark.createDataFrame(rows, "row_id long, y int, t double")
    cut = evaluation.sliced(s, ["y", "t", "row_id"]).groupBy("slice_").count().collect()
    assert len(cut) == 64 and max(r["count"] for r in cut) < 3000 / 16
    want = {i: k + 1 for k, (i, _, _) in enumerate(sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0.0, r[0])))}
    assert {r.row_id: r.r for r in evaluation.numbered(s, ["t", "row_id"], []).collect()} == want
    fold = evaluation.folds(s).groupBy("y", "fold").count().collect()
    assert len(fold) == 15 and all(max(r["count"] for r in fold if r.y == y) - min(r["count"] for r in fold if r.y == y) <= 1 for y in (0, 1, None))
    got = {r.y: (r.a, r.b) for r in evaluation.nearest_ranks(s, "y", "t", {"a": 0.5, "b": 0.99}).collect()}
    for y in (0, 1, None):
        v = sorted(t for _, g, t in rows if g == y and t is not None)
        assert got[y] == (v[len(v) // 2], v[math.floor(len(v) * 0.99)])


def test_late_velocity_joins_no_mentions(spark):
    """By running sums: no mention is joined with another, only slices with what is before them."""
    rng = random.Random(2)
    rows = [("e", "hn", float(i * 10 + rng.randint(-300, 0)), i) for i in range(400)]
    m = spark.createDataFrame(rows, "entity_id string, platform string, t double, arrival long")
    found = velocity.late_velocity(m, 60)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any("(t#" in x or " t#" in x for x in joins)
    got = {r.arrival: r.n_events for r in found.collect()}
    for i in range(400):
        newest = max(r[2] for r in rows[: i + 1])
        assert got.get(i, 0) == sum(r[2] >= newest - 60 for r in rows[: i + 1])


def test_later_batches_merge(spark, tmp_path):
    from ripplemill.streaming import pipeline as stream

    def batch(*values):
        return spark.createDataFrame([("t", 0, i, v) for i, v in values], "topic string, partition int, offset long, value string")

    story = '{"id": "%s", "platform": "hn", "author": "%s", "title": "%s", "ingested_at": "2026-01-01T00:00:0%d"}'
    push = '{"id": "%s", "platform": "github", "type": "PushEvent", "repo": "r", "actor": "b", "created_at": "2026-01-01T00:00:05"}'
    write = stream.writer(f"{tmp_path}/out")
    first = batch((1, story % ("1", "a", "Big Tech", 1)), (2, push % "2"))
    second = batch((4, push % "3"), (5, story % ("4", "a", "Big Tech", 3)))
    for number, df in ((0, first), (1, second), (1, second), (0, first)):
        write(ingest.decode(df), number)
    edges = spark.read.parquet(f"{tmp_path}/out/edges")
    # authored and mentions of two stories, one push: the second push has the key of the first
    assert edges.count() == 5 and edges.select("source_id", "target_id", "platform", "ts").distinct().count() == 5
    assert spark.read.parquet(f"{tmp_path}/out/mentions").where("ts IS NULL").count() == 0
    merged = {r.id: r for r in stream.nodes(spark, f"{tmp_path}/out").collect()}
    assert set(merged) == {"hn:1", "hn:4", "hn:user:a", "github:repo:r", "github:user:b", *(i for i in merged if i.startswith("entity:"))} and len(merged) == 6
    a = merged["hn:user:a"]
    assert (a.first_seen.second, a.last_seen.second) == (1, 3)


def test_stream_scores_as_the_batch_does(spark, tmp_path):
    """Two files of mentions, one after another, through the stateful operator."""
    from ripplemill.streaming.pipeline import scored

    rng = random.Random(9)
    rows = [(f"e{i % 2}", float(i * 7 + rng.randint(0, 6)), i) for i in range(160)]
    m = spark.createDataFrame(rows, "entity_id string, t double, arrival long")
    for k, part in enumerate((m.where("arrival < 90"), m.where("arrival >= 90"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = scored(spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), 60.0)
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.entity_id, r.arrival): (r.n_events, r.ewma, r.poisson, r.fired) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    v = velocity.velocity(m, 60.0)
    want = {(r.entity_id, r.arrival): (r.n_events, r.ewma, r.poisson, r.fired) for r in velocity.sequential_scores(v).join(v.select("entity_id", "arrival", "n_events"), ["entity_id", "arrival"]).collect()}
    assert got == want and len(got) == 160


def test_verdict_cases(spark):
    from ripplemill.operators import agent

    rest = ', "signals": ["steady growth"], "reasoning_steps": ["checked the path"]}'
    good = '{"classification": "organic", "confidence": 0.8' + rest
    found, none, others = [("get_path", "3 posts", False)], [("get_path", "nothing", True)], [("search_similar_trends", "two", False)]
    cases = [
        (good, found, "organic", 0.8),
        (f"```json\n{good}\n```", found, "organic", 0.8),
        (f"```\n{good}\n``` and {{more}}", found, "organic", 0.8),
        (f"Here is my analysis.\n{good}\nHope that helps!", found, "organic", 0.8),
        (f'<think>{{"x": 1}}</think>{good}', found, "organic", 0.8),
        (good.replace('"organic"', '"ORGANIC"'), found, "uncertain", 0.8),
        (good.replace('"organic"', '"definitely_bots"'), found, "uncertain", 0.8),
        (good.replace('"organic"', "7"), found, "uncertain", 0.8),
        (good.replace("0.8", '"0.42"'), found, "organic", 0.42),
        (good.replace("0.8", "7"), found, "organic", 7.0),
        (good.replace("0.8", "true"), found, "organic", 1.0),
        (good.replace("0.8", '"1e-1"'), found, "organic", 0.1),
        (good.replace("0.8", '"high"'), found, None, None),
        (good.replace("0.8", "null"), found, None, None),
        (good.replace("0.8", "[1]"), found, None, None),
        (good.replace('["steady growth"]', "3"), found, None, None),
        *((good.replace(f'"{k}"', '"other"'), found, None, None) for k in agent.KEYS),
        ('{"classification": "organic", "confidence": 1, "evidence": ["a"]}', found, None, None),
        ("I could not determine an answer.", found, None, None),
        ("} {", found, None, None),
        (None, found, None, None),
        (good, [], None, None),
        (good, None, None, None),
        (good, none, "uncertain", 0.3),
        (good, others, "uncertain", 0.3),
        (good.replace("0.8", "0.1"), none, "uncertain", 0.1),
        (good, none + found, "organic", 0.8),
    ]
    rows = spark.createDataFrame([(i, r, e) for i, (r, e, _, _) in enumerate(cases)], "k int, reply string, events array<struct<tool: string, summary: string, empty: boolean>>")
    got = agent.verdicts(rows).orderBy("k").collect()
    assert [(r.classification, r.confidence) for r in got] == [(c, n) for _, _, c, n in cases]
    assert [r.valid for r in got] == [c is not None for _, _, c, _ in cases]
    last = got[-1]
    assert (last.signals, last.reasoning_steps, last.evidence) == (["steady growth"], ["checked the path"], ["get_path: nothing", "get_path: 3 posts"])
    assert got[-4].signals == [agent.NOTHING_FOUND, "steady growth"] and got[-4].evidence == ["get_path: nothing"]


def test_ancestries_of_cycles_and_joins(spark):
    """Paths by doubling against a walk, in a graph with two ways to a node and a cycle."""
    from ripplemill.operators import graph

    pairs = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e")]
    edges = spark.createDataFrame(pairs, "source_id string, target_id string")
    want, level = [], [(a, b, 1) for a, b in pairs]
    while level and level[0][2] <= 7:
        want += level
        level = [(a, y, d + 1) for a, b, d in level for x, y in pairs if x == b]
    assert sorted((r.above, r.node, r.d) for r in graph.ancestries(edges, 7).collect()) == sorted(want)
    path = graph.propagation_path(edges.withColumns({"edge_type": evaluation.F.lit("x"), "platform": evaluation.F.lit("p"), "ts": evaluation.F.lit(0)}), "it's", 3)
    assert path.count() == 0


def test_learning(spark):
    from ripplemill.operators import learning

    rng = random.Random(3)
    rows = spark.createDataFrame([(i, a := rng.random(), rng.random(), float(a + rng.gauss(0, 0.1) > 0.5)) for i in range(300)], "row_id long, a double, b double, y double")
    for pipeline in (learning.trees(["a", "b"], 5), learning.logistic(["a", "b"])):
        assert evaluation.roc_auc(learning.out_of_fold(pipeline, rows, 3)).first().roc_auc > 0.9
    assert learning.importances(learning.trees(["a", "b"], 3).fit(rows), ["a", "b"], spark).first().feature == "a"
    top = learning.attributed(learning.logistic(["a", "b"]).fit(rows), rows, ["a", "b"], "row_id", 1).where("abs(p - 0.5) > 0.4").collect()
    assert top and all(r.top[0].feature == "a" for r in top)
    joined, dropped = learning.labelled(rows.drop("y"), rows.select("row_id", "y").where("row_id >= 10").union(spark.createDataFrame([(999, 1.0)], "row_id long, y double")), "row_id")
    assert joined.count() == 290 and tuple(dropped.first()) == (10, 1)


def test_approximate_search(spark):
    rng = random.Random(4)
    middle = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.15) for x in middle[i % 12]], f"l{i % 2}") for i in range(600)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    q = v.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS q", "label")
    exact, found = search.top_k(v, q), search.approximate(v, q).cache()
    similar = {(r.query_id, r.vec_id): r.similarity for r in search.top_k(v, q, 600).collect()}
    got = found.collect()
    assert all(abs(similar[r.query_id, r.vec_id] - r.similarity) < 1e-9 for r in got)
    assert any(r.vec_id % 3 == 0 for r in got) and {r["rank"] for r in got} == {1, 2, 3, 4, 5}
    assert search.recall_at_k(exact, found).first().recall > 0.9


def test_recall_is_of_the_index(spark):
    exact, found = entry.queries()["v1_top_k"](spark, SF), entry.queries()["v3_approximate"](spark, SF)
    assert entry.queries()["v4_recall"](spark, SF).first().recall == round(search.recall_at_k(exact, found).first().recall, 6)


@pytest.mark.parametrize("name", ["p3_recent_edges", "g3_degrees", "a17_latency_percentiles", "w1_t1_velocity", "c5_trending", "e2_roc_auc", "w1_upsert_nodes", "x9_dedup"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in got.columns]
    want = sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())
    assert sorted(str(tuple(r)) for r in got.collect()) == want
