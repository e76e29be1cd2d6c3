"""Seen-sets, scans to end offsets, idempotent loads, quarantined batches and lag, against plain loops."""

import json
import os
import random
import zlib  # noqa: F401
from hashlib import md5

import pytest

from pyspark.sql import functions as F

from ripplemill.operators import loading
from ripplemill.streaming import monitor, seen


class PlainSeen:
    def __init__(self, most):
        self.most, self.ids = most, []

    def new(self, key):
        if key in self.ids:
            return False
        self.ids.append(key)
        if len(self.ids) > self.most:
            del self.ids[: self.most // 2]
        return True


def repeated(seed, n, keys, hot=0.4):
    """Records of which many have one of a few ids, some are bad."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.05
        key = "hot" if rng.random() < hot else f"r{rng.randrange(keys)}"
        rows.append((i % 3, i // 3, rng.choice(["hn", "hn", None]), key, "not JSON" if bad else None))
    return rows


def plain_fresh(rows, most, shards):
    sets, out = [PlainSeen(max(1, most // shards)) for _ in range(shards)], []
    for p, o, platform, key, error in sorted(rows, key=lambda r: (r[0], r[1])):
        name = f"{platform or 'unknown'}:{key}"
        if error or sets[int(md5(name.encode()).hexdigest()[:8], 16) % shards].new(name):
            out.append((p, o))
    return sorted(out)


FIELDS = "partition int, offset long, platform string, id string, error string"


@pytest.mark.parametrize("most,shards", [(1000, 4), (40, 4), (6, 1)])
def test_bounded_seen_set(spark, most, shards):
    rows = repeated(1, 400, 60)
    df = spark.createDataFrame(rows, FIELDS).repartition(3)
    with seen.rocks(spark):
        got = seen.first_seen(df, most, shards).collect()
    assert sorted((r["partition"], r["offset"]) for r in got) == plain_fresh(rows, most, shards)


def test_seen_set_goes_on_from_batch_to_batch(spark, tmp_path):
    """Three files, each a micro-batch, and a restart between the second and the third."""
    rows = repeated(2, 300, 40)
    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"
    parts = [sorted(rows[k : k + 100]) for k in (0, 100, 200)]

    def run():
        stream = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/raw")
        with seen.rocks(spark):
            q = seen.first_seen(stream, 40, 4).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
            q.awaitTermination(300)

    for k, part in enumerate(parts):
        spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/raw")
        os.utime(f"{tmp_path}/raw")
        if k:
            run()
    sets, want = [PlainSeen(10) for _ in range(4)], []
    for part in parts:
        for p, o, platform, key, error in part:
            name = f"{platform or 'unknown'}:{key}"
            if error or sets[int(md5(name.encode()).hexdigest()[:8], 16) % 4].new(name):
                want.append((p, o))
    assert sorted((r["partition"], r["offset"]) for r in spark.read.parquet(out).collect()) == sorted(want)


def test_ingest_refuses_what_comes_again_and_reads_only_its_days(spark, tmp_path):
    from ripplemill.streaming.pipeline import ingest, nodes

    def rec(i, day, **more):
        return json.dumps({"id": f"{i}", "platform": "hn", "author": f"a{int(i) % 3}", "title": "x", "created_at": f"2026-01-{day:02d}T00:00:00Z"} | more)

    first = [("t", 0, k, rec(k % 4, 1 + k % 2)) for k in range(8)] + [("t", 0, 8, "{not json")]
    again = [("t", 0, 9, rec(1, 2)), ("t", 0, 10, rec(7, 1, parent_id="1")), ("t", 0, 11, rec(7, 1, parent_id="1")), ("t", 0, 12, rec(1, 2, id="1\x00", author="a\x001"))]
    raw = f"{tmp_path}/raw"
    for part in (first, again):
        spark.createDataFrame(part, "topic string, partition int, offset long, value string").coalesce(1).write.mode("append").parquet(raw)
        q = ingest(spark.readStream.schema("topic string, partition int, offset long, value string").parquet(raw), f"{tmp_path}/out", f"{tmp_path}/ck")
        q.awaitTermination(300)
    edges = spark.read.parquet(f"{tmp_path}/out/edges")
    assert edges.where("edge_type = 'authored'").count() == 5 and edges.where("edge_type = 'reshare'").count() == 1
    assert {str(r.day) for r in edges.select("day").distinct().collect()} == {"2026-01-01", "2026-01-02"}
    assert spark.read.parquet(f"{tmp_path}/out/dead").select("offset").collect()[0][0] == 8
    assert nodes(spark, f"{tmp_path}/out").where("type = 'author'").count() == 3
    assert len(os.listdir(f"{tmp_path}/out/edges")) >= 2


def test_scan_stops_at_the_ends_it_was_given(spark):
    """Markers at the end of a partition, messages that come later, a partition that is new."""
    log = [("t", 0, 0, 1000, "a"), ("t", 0, 1, 2000, "b"), ("t", 0, 2, 2000, None), ("t", 1, 0, 500, "c")]
    schema = "topic string, partition int, offset long, timestamp long, value string"
    ends = loading.end_offsets(spark.createDataFrame(log, schema))
    assert sorted((r.partition, r.end) for r in ends.collect()) == [(0, 3), (1, 1)]
    later = spark.createDataFrame([*log, ("t", 0, 3, 3000, "d"), ("t", 1, 1, 3000, "e"), ("t", 2, 0, 3000, "f")], schema)
    assert sorted(r.value for r in loading.scan_to(later, ends).collect()) == ["a", "b", "c"]
    assert sorted(r.value for r in loading.scan_to(later, ends, 1.0).collect()) == ["a", "b"]
    committed = spark.createDataFrame([("t", 0, 1)], "topic string, partition int, offset long")
    assert {(r.partition, r.lag) for r in monitor.offset_lag(ends, committed).collect()} == {(0, 2), (1, 1)}
    assert monitor.oldest_waiting(spark.createDataFrame(log, schema), committed, 10.0).first().behind_s == 9.5
    done = spark.createDataFrame([("t", 0, 3), ("t", 1, 1)], "topic string, partition int, offset long")
    assert monitor.oldest_waiting(spark.createDataFrame(log, schema), done, 10.0).first().behind_s == 0.0


def test_loads_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", None, 3), ("b", None, 4)], "id string, platform string, arrival long")
    path = f"{tmp_path}/nodes"
    assert loading.bulk_append(rows, path, ["id", "platform"], "arrival") == 2
    assert loading.bulk_append(rows, path, ["id", "platform"], "arrival") == 0
    more = rows.union(spark.createDataFrame([("c", "x", 9)], rows.schema))
    assert loading.bulk_append(more, path, ["id", "platform"], "arrival", last=True) == 1
    assert sorted(r.arrival for r in spark.read.parquet(path).collect()) == [1, 3, 9]
    assert sorted(r.arrival for r in loading.to_append(rows, ["id", "platform"], "arrival", last=True).collect()) == [2, 4]


def test_batches_are_whole_or_not_there(spark, tmp_path):
    path, rows = f"{tmp_path}/b", spark.createDataFrame([(1, "1.5"), (None, "2"), (3, "x"), (None, "y")], "id int, weight string")
    checks = {"no id": F.col("id").isNotNull(), "no number": F.col("weight").try_cast("double").isNotNull()}
    assert loading.batches(spark, path, "rows") is None
    calls = []

    def failing(times):
        def write(df, to):
            calls.append(to)
            if len(calls) <= times:
                raise OSError("busy")
            df.write.parquet(to)

        return write

    with pytest.raises(OSError):
        loading.write_batch(rows, path, 1, checks, write=failing(99))
    assert len(calls) == 3 and loading.batches(spark, path, "rows") is None
    calls.clear()
    assert loading.write_batch(rows, path, 1, checks, write=failing(2)) == 3
    assert loading.write_batch(rows, path, 2, checks) == 1
    assert loading.write_batch(rows.where("id = 1"), path, 2, checks) == 1  # a replay overwrites itself
    good, bad = loading.batches(spark, path, "rows"), loading.batches(spark, path, "dead")
    assert sorted((r.batch, r.id) for r in good.collect()) == [(1, 1), (2, 1)]
    assert sorted((r.batch, r.error, r.weight) for r in bad.collect()) == [(1, "no id", "2"), (1, "no id", "y"), (1, "no number", "x")]
    os.rmdir(f"{path}/_done/batch=2")  # a batch that stopped before its marker does not count
    assert loading.batches(spark, path, "rows").count() == 1
    assert not [x for x in os.listdir(path) if x.startswith("_staged")]


def test_labels_leak_nothing(spark, tmp_path):
    y = spark.createDataFrame([(0.5, "ev:1", 9, "organic", "plain", "t", "2026-01-01 00:00:00")], "bot_frac double, root_node_id string, size int, label string, subtype string, topic_id string, t0 string")
    loading.write_labels(y, f"{tmp_path}/labels")
    got = loading.labels_from(spark, f"{tmp_path}/labels")
    assert got.columns == ["root_node_id", "label", "subtype", "topic_id", "t0"] and got.first().label == "organic"


def test_progress_to_samples():
    p = {"id": "q", "name": None, "batchId": 3, "timestamp": "2026-01-01T00:01:00.000Z", "numInputRows": 10, "inputRowsPerSecond": 2.0, "processedRowsPerSecond": 5.0, "durationMs": {"triggerExecution": 1500}}
    p["sources"] = [{"endOffset": {"t": {"0": 5, "1": 7}}, "latestOffset": {"t": {"0": 9, "1": 7}}}, {"endOffset": "3", "latestOffset": "10"}, {"endOffset": None, "latestOffset": None}]
    p["eventTime"] = {"watermark": "2026-01-01T00:00:30.000Z"}
    row = monitor.sample(p)
    assert row[:2] == ("q", 3) and row[3:7] == (26, 15, 11, 30.0) and row[7:] == (10, 2.0, 5.0)
    p["sources"] = p["sources"][:0]
    assert monitor.sample(p)[3:7] == (0, 0, 0, 0.0)


def test_monitor_listens(spark, tmp_path):
    spark.range(50).repartition(2).write.parquet(f"{tmp_path}/in")
    m = monitor.Monitor(spark, f"{tmp_path}/progress")
    spark.streams.addListener(m)
    try:
        q = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
        import time

        for _ in range(60):
            if os.path.isdir(f"{tmp_path}/progress") and spark.read.schema(monitor.SAMPLE).parquet(f"{tmp_path}/progress").agg(F.sum("rows")).first()[0] == 50:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(m)
    assert spark.read.parquet(f"{tmp_path}/progress").agg(F.sum("rows")).first()[0] == 50
