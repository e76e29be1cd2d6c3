"""Features and models of many cascades: how they are dealt to tasks, and that results stay."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ripplemill.operators import features, graph, learning, working

SF = "/root/testdata/sf0.001"


def test_features_are_dealt_by_their_rows(spark, monkeypatch):
    """The number of tasks follows from the edges; every family is written by itself; the session is left as it was."""
    monkeypatch.setattr(working, "TASK_ROWS", 60)
    seen, plain = [], working.written

    def written(df, name="table"):
        seen.append((name, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        return plain(df, name)

    monkeypatch.setattr(features, "written", written)
    monkeypatch.setattr(graph, "written", written)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    got = entry.queries()["c4_rounded_features"](spark, SF)
    # 950 reshares
    assert {n for _, n in seen} == {16} and [n for n, _ in seen].count("family") == 5 and seen[-1][0] == "features"
    assert {k: spark.conf.get(k, None) for k in before} == before
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(entry.oracle_sql()["c4_rounded_features"])
    at = [[d[0] for d in cur.description].index(c) for c in got.columns]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())


def test_settings_return_after_an_error(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ZeroDivisionError), working.finely_dealt(spark, 10_000_000):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
        1 / 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_models_read_what_is_written(spark):
    """Scores out of fold and attributions don't repeat what their rows come from, nor join."""
    rows = spark.range(120).selectExpr("id AS row_id", "cast(id % 2 AS double) AS y", "cast(id % 7 + id % 2 AS double) AS a", "cast(id % 5 AS double) AS b")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    scores = learning.out_of_fold(learning.logistic(["a", "b"]), rows, 2)
    assert "Window" not in plan(scores) and scores.count() == 120
    model = learning.logistic(["a", "b"]).fit(rows)
    got = learning.attributed(model, rows, ["a", "b"], "row_id", 2)
    assert "Join" not in plan(got)
    mean = rows.selectExpr("avg(a)").first()[0]
    p = {r.row_id: r.p for r in learning.scored(model, rows).collect()}
    without = {r.row_id: r.p for r in learning.scored(model, rows.selectExpr("row_id", f"{mean}D AS a", "b")).collect()}
    for r in got.collect():
        assert r.p == p[r.row_id] and dict((x.feature, x.value) for x in r.top)["a"] == pytest.approx(p[r.row_id] - without[r.row_id], abs=1e-12)
