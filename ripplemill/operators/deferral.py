"""When not to answer: a second model that says whether the first will be right, and gates compared at equal coverage."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .learning import out_of_fold, scored, trees
from .working import written

# The gates tried (0.05 to 0.98), the accuracies asked for, and how much has to be published.
GATES = [round(0.05 + 0.01 * k, 2) for k in range(94)]
TARGETS = [0.9, 0.925, 0.95, 0.97]
LEAST_COVERAGE = 0.25


def confidence(p: Column) -> Column:
    return F.greatest(p, 1 - p)


def correct(p: Column, y: Column) -> Column:
    return ((p >= 0.5).cast("int") == y.cast("int")).cast("int")


def fit_deferral(rows: DataFrame, columns: list[str], classifier: Pipeline, k: int = 5, rounds: int = 20):
    """A model of whether ``classifier`` is right, from its out-of-fold scores on ``rows`` (row_id, y, *columns) and the rows themselves.

    Scores of rows that the classifier was fitted on would be right nearly always and teach
    that nothing is hard.
    """
    judged = written(with_verdict(out_of_fold(classifier, rows, k)), "out-of-fold")
    return trees([*columns, "p_coordinated", "model_confidence"], rounds).fit(judged.withColumn("y", F.col("correct").cast("double")))


def with_verdict(rows: DataFrame) -> DataFrame:
    """``rows`` (y, p, ..) with what the second model sees of the first, and whether that was right."""
    return rows.withColumns({"p_coordinated": F.col("p"), "model_confidence": confidence(F.col("p")), "correct": correct(F.col("p"), F.col("y"))})


def deferred(model, classifier_scores: DataFrame) -> DataFrame:
    """``classifier_scores`` (y, p, ..) with correct, confidence and p_correct."""
    judged = with_verdict(classifier_scores).drop("p")
    out = scored(model, judged)
    return out.select(*judged.columns, F.col("p").alias("p_correct")).withColumnRenamed("model_confidence", "confidence")


def gate_curve(rows: DataFrame, score: str, gates: list[float] | None = None) -> DataFrame:
    """(threshold, coverage, accuracy, n) of what each gate publishes of ``rows`` (score, correct); gates that publish nothing are left out.

    Each row is counted once, under the highest gate that it passes; the rest is a running sum
    over the gates.
    """
    gates = gates or GATES
    passed = F.aggregate(F.array(*[F.lit(g) for g in gates]), F.lit(0), lambda n, g: n + (F.col(score) >= g).cast("int"))
    counts = rows.groupBy(passed.alias("passed")).agg(F.count("*").alias("k"), F.sum("correct").alias("good"))
    spark = rows.sparkSession
    every = spark.createDataFrame([(i + 1, g) for i, g in enumerate(gates)] + [(0, None)], "passed int, threshold double")
    up = Window.orderBy(F.desc("passed")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a gate
    j = every.join(F.broadcast(counts), "passed", "left").withColumns({"n": F.coalesce(F.sum("k").over(up), F.lit(0)), "good_": F.sum("good").over(up), "all_": F.sum("k").over(Window.partitionBy())})
    return j.where("threshold IS NOT NULL AND n > 0").select("threshold", (F.col("n") / F.col("all_")).alias("coverage"), (F.col("good_") / F.col("n")).alias("accuracy"), "n")


def choose_gates(curve: DataFrame, targets: list[float] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """(target, threshold, accuracy, coverage): the gate that publishes most at the target's accuracy, of equals the lowest; if none does, the most accurate one. At least ``least`` is published."""
    spark = curve.sparkSession
    wanted = spark.createDataFrame([(t,) for t in targets or TARGETS], "target double")
    rows = wanted.crossJoin(F.broadcast(curve.where(F.col("coverage") >= least)))
    reached = F.col("accuracy") >= F.col("target")
    best = F.min_by(F.struct("threshold", "accuracy", "coverage"), F.struct((~reached).cast("int").alias("miss"), F.when(reached, -F.col("coverage")).otherwise(-F.col("accuracy")).alias("order"), F.when(reached, F.col("threshold")).otherwise(-F.col("threshold")).alias("then")))
    return rows.groupBy("target").agg(best.alias("b")).select("target", "b.*")


def matched(chosen: DataFrame, other: DataFrame) -> DataFrame:
    """``chosen`` with the gate of another curve whose coverage is nearest, of equals the lowest, and its accuracy."""
    o = other.select(F.col("threshold").alias("other_threshold"), F.col("coverage").alias("c_"), F.col("accuracy").alias("other_accuracy"))
    j = chosen.crossJoin(F.broadcast(o))
    near = F.min_by(F.struct("other_threshold", "other_accuracy"), F.struct(F.abs(F.col("c_") - F.col("coverage")), "other_threshold"))
    return j.groupBy(*chosen.columns).agg(near.alias("o")).select(*chosen.columns, "o.*")


def compare_gates(rows: DataFrame, targets: list[float] | None = None) -> DataFrame:
    """(target, threshold, accuracy, coverage, other_threshold, other_accuracy): gates by p_correct against those by confidence that publish as much."""
    rows = written(rows.select("p_correct", "confidence", "correct"), "gated")
    return matched(choose_gates(gate_curve(rows, "p_correct"), targets), gate_curve(rows, "confidence"))


def published(rows: DataFrame, by: str, gates: dict[str, tuple[str, float]]) -> DataFrame:
    """(by, gate, n, published, accuracy): of each group the share that each gate (column, threshold) publishes, and how often that is right."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("gate"), (F.col(c) >= t).alias("on")) for name, (c, t) in gates.items()]))
    x = rows.select(by, "correct", each.alias("g")).select(by, "correct", "g.*")
    return x.groupBy(by, "gate").agg(F.count("*").alias("n"), F.avg(F.col("on").cast("double")).alias("published"), F.avg(F.when(F.col("on"), F.col("correct"))).alias("accuracy"))
