"""Evaluation of classifiers and detectors as aggregations over (y, p) and detection tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def sliced(s: DataFrame, keys: list[str], slices: int = 64) -> DataFrame:
    """``s`` with a number ``slice_`` that rises with the keys; the cuts come from a bounded sample, so slices are about even."""
    some = s.select(*keys).orderBy(F.xxhash64(*keys)).limit(slices * 32).orderBy(*keys).collect()
    kinds = [s.schema[k].dataType for k in keys]
    cuts = sorted({len(some) * k // slices for k in range(1, slices)} - {0})
    bounds = [F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, some[c], kinds)]) for c in cuts if c < len(some)]
    if not bounds:
        return s.withColumn("slice_", F.lit(0))
    own = F.struct(*keys)
    return s.withColumn("slice_", sum(((own >= b).cast("int") for b in bounds), F.lit(0)))


def before_slices(per: DataFrame, by: list[str]) -> DataFrame:
    """``per`` (by, slice_, n_), a row for each slice, with the sum of n_ in the slices before it."""
    w = Window.partitionBy(*by).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("slice_").alias("slice_of"), F.coalesce(F.sum("n_").over(w), F.lit(0)).alias("before_"))


def with_before(s: DataFrame, per: DataFrame, by: list[str]) -> DataFrame:
    on = [s[c].eqNullSafe(F.col(f"{c}_of")) for c in by] + [s["slice_"] == F.col("slice_of")]
    return s.join(F.broadcast(before_slices(per, by)), on).drop(*[f"{c}_of" for c in by], "slice_of")


def numbered(s: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``s`` with its row number ``r`` in the order of the keys, for each ``by``: a group's rows are ranked in slices, not in one task."""
    cut = sliced(s, [*by, *keys])
    per = cut.groupBy(*by, "slice_").agg(F.count("*").alias("n_"))
    inside = F.row_number().over(Window.partitionBy(*by, "slice_").orderBy(*keys))
    return with_before(cut, per, by).withColumn("r", inside + F.col("before_")).drop("slice_", "before_")


def nearest_ranks(s: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each ``by`` the value at place floor(n * share) of its sorted values (nulls left out): equal values are counted and the counts summed in slices."""
    counts = sliced(s.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("k")), [by, value])
    per = counts.groupBy(by, "slice_").agg(F.sum("k").alias("n_"))
    upto = F.sum("k").over(Window.partitionBy(by, "slice_").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    run = with_before(counts, per, [by]).withColumn("upto", upto + F.col("before_"))
    all_ = per.groupBy(F.col(by).alias("of_")).agg(F.sum("n_").alias("all_"))
    run = run.join(F.broadcast(all_), F.col(by).eqNullSafe(F.col("of_")))
    at = lambda q: F.floor(F.col("all_") * q)
    return run.groupBy(by).agg(*[F.min(F.when((F.col("upto") > at(q)) & (F.col("upto") - F.col("k") <= at(q)), F.col(value))).alias(c) for c, q in shares.items()])


def running(per: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """``per``, one row a key, with ``{c}_before``: the sum of c over all smaller keys. Sums run inside slices of keys, and over slices, so no task sees all keys."""
    cut = sliced(per, [key])
    inside = Window.partitionBy("slice_").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    slices = cut.groupBy("slice_").agg(*[F.sum(c).alias(c) for c in sums]).select(F.col("slice_").alias("of_"), *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_of_") for c in sums])
    out = cut.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).join(F.broadcast(slices), F.col("slice_") == F.col("of_"))
    return out.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"{c}_of_") for c in sums}).drop("slice_", "of_", *[f"{c}_of_" for c in sums])


def scorecard(s: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``s`` (y 0/1, p): accuracy, precision, recall and F1 of both classes, macro F1, Brier score."""
    hat = (F.col("p") >= threshold).cast("int")
    n = s.select("y", "p", hat.alias("h")).agg(F.count("*").alias("n"), F.count_if((F.col("y") == 1) & (F.col("h") == 1)).alias("tp"), F.count_if((F.col("y") == 0) & (F.col("h") == 1)).alias("fp"), F.count_if((F.col("y") == 1) & (F.col("h") == 0)).alias("fn"), F.count_if((F.col("y") == 0) & (F.col("h") == 0)).alias("tn"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    f1, f0 = _div(2 * tp, 2 * tp + fp + fn), _div(2 * tn, 2 * tn + fp + fn)
    return n.select((_div(tp + tn, F.col("n"))).alias("accuracy"), _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"), f1.alias("f1"), f0.alias("f1_negative"), ((f1 + f0) / 2).alias("macro_f1"), F.col("brier"))


def roc_auc(s: DataFrame) -> DataFrame:
    """Mann-Whitney with average ranks; null if one class is missing.

    Ranks come from counts of equal scores, so the ordered window runs over distinct scores.
    """
    per = running(s.groupBy("p").agg(F.sum("y").alias("pos"), F.count("*").alias("n")), "p", ["n"])
    r = per.withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2).agg(F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").alias("p1"), F.sum(F.col("n") - F.col("pos")).alias("n0"))
    return r.select(F.when((F.col("p1") > 0) & (F.col("n0") > 0), (F.col("ranks") - F.col("p1") * (F.col("p1") + 1) / 2) / (F.col("p1") * F.col("n0"))).alias("roc_auc"))


def average_precision(s: DataFrame) -> DataFrame:
    per = running(s.groupBy((-F.col("p")).alias("down")).agg(F.sum("y").alias("pos"), F.count("*").alias("n")), "down", ["pos", "n"])
    c = per.withColumn("tp", F.col("pos_before") + F.col("pos")).withColumn("seen", F.col("n_before") + F.col("n"))
    return c.agg((F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.sum("pos")).alias("average_precision"))


def log_loss(s: DataFrame) -> DataFrame:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    return s.agg((-F.avg(F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"))


def reliability(s: DataFrame, bins: int = 8) -> DataFrame:
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return s.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("share"))


def calibration_error(s: DataFrame, bins: int = 10) -> DataFrame:
    r = reliability(s, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))) / F.sum("n")).alias("ece"))


def review_threshold(s: DataFrame, target: float = 0.9) -> DataFrame:
    """The lowest confidence gate of 0.50 to 0.95 whose kept verdicts reach the accuracy, else the last that keeps any."""
    t = s.withColumn("conf", F.greatest("p", 1 - F.col("p"))).withColumn("right", ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int"))
    g = t.withColumn("k", F.explode(F.sequence(F.lit(10), F.lit(19)))).where(F.col("conf") >= F.col("k") * 0.05 - 1e-9)
    a = g.groupBy("k").agg(F.avg("right").alias("acc"), F.count("*").alias("kept"))
    return a.agg(F.coalesce(F.min(F.when(F.col("acc") >= target, F.col("k"))), F.max("k")).alias("k")).select((F.col("k") * 0.05).alias("threshold"))


def risk_coverage(s: DataFrame, steps: int = 10) -> DataFrame:
    """Accuracy of the surest share of rows, in steps."""
    t = s.withColumn("conf", F.greatest("p", 1 - F.col("p"))).withColumn("right", ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int"))
    per = running(t.groupBy((-F.col("conf")).alias("down")).agg(F.sum("right").alias("r"), F.count("*").alias("n")), "down", ["r", "n"])
    c = per.withColumn("seen", F.col("n_before") + F.col("n")).withColumn("good", F.col("r_before") + F.col("r")).crossJoin(F.broadcast(t.agg(F.count("*").alias("all"))))
    return c.groupBy(F.ceil(F.col("seen") * steps / F.col("all")).alias("step")).agg(F.max("seen").alias("kept"), F.max_by(F.col("good") / F.col("seen"), "seen").alias("accuracy"))


def pareto(points: DataFrame) -> DataFrame:
    """Points that none beats in both fewer false alarms and more recall; ties stay."""
    a, b = points.alias("a"), points.alias("b")
    beaten = (F.col("b.fp") <= F.col("a.fp")) & (F.col("b.recall") >= F.col("a.recall")) & ((F.col("b.fp") < F.col("a.fp")) | (F.col("b.recall") > F.col("a.recall")))
    return a.join(b, beaten, "left_anti")


def pick_threshold(points: DataFrame, least_recall: float) -> DataFrame:
    return points.where(F.col("recall") >= least_recall).orderBy("fp", F.desc("recall"), "threshold").limit(1)


def threshold_sweep(s: DataFrame) -> DataFrame:
    """Recall and false alarms at each threshold 0.1 to 0.9 in one pass."""
    g = s.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn("hit", F.col("p") >= F.col("k") / 10)
    return g.groupBy("k").agg((F.count_if(F.col("hit") & (F.col("y") == 1)) / F.count_if(F.col("y") == 1)).alias("recall"), F.count_if(F.col("hit") & (F.col("y") == 0)).alias("fp")).select((F.col("k") / 10).alias("threshold"), "recall", "fp")


def bootstrap_gain(s: DataFrame, replicates: int = 2000, seed: int = 5) -> DataFrame:
    """Means and percentile intervals of the gains of p over q in ROC-AUC, macro F1 and accuracy, by Poisson weights of hashed rows.

    Rows with a null are left out, and replicates with one class only. A replicate's weights are
    summed for each score, so its ordered window runs over distinct scores.
    """
    u = F.shiftrightunsigned(F.xxhash64("row_id", "k", F.lit(seed)), 11) / F.lit(float(1 << 53))
    # Poisson(1) by inversion; a weight over 10 has a chance of 1e-8
    cuts = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(11)]
    weight = sum(((F.col("u") >= c).cast("int") for c in cuts), F.lit(0))
    rows = s.where("y IS NOT NULL AND p IS NOT NULL AND q IS NOT NULL").select("row_id", "y", "p", "q")
    r = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("u", u).select("k", "y", "p", "q", weight.alias("w")).where("w > 0")
    per = None
    for side in ("p", "q"):
        counts = r.groupBy("k", F.lit(side).alias("side"), F.col(side).cast("double").alias("score")).agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum("w").alias("n"))
        per = counts if per is None else per.union(counts)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k", "side").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hat = F.col("score") >= 0.5
    sums = per.withColumn("rank", before + (F.col("n") + 1) / 2).groupBy("k", "side").agg(
        F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").alias("p1"), F.sum(F.col("n") - F.col("pos")).alias("n0"),
        F.sum(F.when(hat, F.col("pos")).otherwise(0)).cast("double").alias("tp"), F.sum(F.when(hat, F.col("n") - F.col("pos")).otherwise(0)).cast("double").alias("fp"),
    ).where("p1 > 0 AND n0 > 0")
    fn, tn = F.col("p1") - F.col("tp"), F.col("n0") - F.col("fp")
    f1 = _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + fn) / 2 + _div(2 * tn, 2 * tn + F.col("fp") + fn) / 2
    auc = (F.col("ranks") - F.col("p1") * (F.col("p1") + 1) / 2) / (F.col("p1") * F.col("n0"))
    each = sums.select("k", F.when(F.col("side") == "p", 1).otherwise(-1).alias("sign"), auc.alias("auc"), f1.alias("f1"), ((F.col("tp") + tn) / (F.col("p1") + F.col("n0"))).alias("accuracy"))
    names = {"auc": "auc_", "f1": "f1_", "accuracy": ""}
    g = each.groupBy("k").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in names])
    return g.agg(*[x for c, n in names.items() for x in (F.avg(c).alias(f"{n}gain"), F.percentile(c, 0.025).alias(f"{n}low"), F.percentile(c, 0.975).alias(f"{n}high"))], F.count("*").alias("replicates"))


def _hashed(s: DataFrame, seed: int) -> DataFrame:
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string")))
    return numbered(s.withColumn("hash_", place), ["hash_", "row_id"], ["y"]).drop("hash_")


def stratified(s: DataFrame, n: int, seed: int = 3) -> DataFrame:
    """n // 2 rows of each class, by hashed row."""
    return _hashed(s, seed).where(F.col("r") <= n // 2).drop("r")


def temporal_split(s: DataFrame, share: float = 0.8) -> DataFrame:
    """The first ``floor(n * share)`` rows in time are for training."""
    n = s.agg(F.count("*").alias("n"))
    r = numbered(s, ["t", "row_id"], []).crossJoin(F.broadcast(n))
    return r.withColumn("train", F.col("r") <= F.floor(F.col("n") * share)).drop("r", "n")


def folds(s: DataFrame, k: int = 5, seed: int = 3) -> DataFrame:
    return _hashed(s, seed).withColumn("fold", ((F.col("r") - 1) % k).cast("int")).drop("r")


def shape_comparison(real: DataFrame, other: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, real_p50, real_p90, other_p50, other_p90) of two populations on the same features."""

    def quantiles(rows: DataFrame, name: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
        return rows.select(each.alias("x")).groupBy("x.metric").agg(F.percentile("x.v", 0.5).alias(f"{name}_p50"), F.percentile("x.v", 0.9).alias(f"{name}_p90"))

    return quantiles(real, "real").join(quantiles(other, "other"), "metric", "full")


def spread(repeats: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, mean, least, most, repeats) of each metric over repeated runs; undefined values don't count."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
    rows = repeats.select(*by, each.alias("x")).select(*by, "x.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    return rows.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("repeats"))
