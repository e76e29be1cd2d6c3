"""Classifiers over feature tables with pyspark.ml: fits, out-of-fold scores, calibration, importances, attributions."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import folds, log_loss, roc_auc
from .working import written


def labelled(features: DataFrame, labels: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Features with their labels, and one row with how many of either have no partner. Labels give the key and y only."""
    y = labels.select(key, "y").where(F.col("y").isNotNull())
    left = features.join(y, key, "left_anti").agg(F.count("*").alias("unlabelled"))
    right = y.join(features, key, "left_anti").agg(F.count("*").alias("without_features"))
    return features.join(y, key), left.crossJoin(right)


def trees(columns: list[str], rounds: int = 20, depth: int = 3, seed: int = 1) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x_", handleInvalid="keep"), GBTClassifier(featuresCol="x_", labelCol="y", maxIter=rounds, maxDepth=depth, seed=seed)])


def logistic(columns: list[str], penalty: float = 0.01) -> Pipeline:
    """Standardised logistic regression."""
    scaled = StandardScaler(inputCol="x_", outputCol="z_", withMean=True, withStd=True)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x_"), scaled, LogisticRegression(featuresCol="z_", labelCol="y", regParam=penalty)])


def scored(model, rows: DataFrame) -> DataFrame:
    """``rows`` with p, the probability of 1."""
    out = model.transform(rows)
    return out.select(*rows.columns, vector_to_array("probability")[1].alias("p"))


def out_of_fold(pipeline: Pipeline, rows: DataFrame, k: int = 5) -> DataFrame:
    """``rows`` (row_id, y, ..) with p from the model that was fitted without the row's fold."""
    dealt = written(folds(rows, k), "folds")  # each fold's model reads it again
    return reduce(DataFrame.union, [scored(pipeline.fit(dealt.where(F.col("fold") != f)), dealt.where(F.col("fold") == f)) for f in range(k)])


def best_of(candidates: dict[str, Pipeline], rows: DataFrame, k: int = 3) -> DataFrame:
    """(name, log_loss) of each candidate by out-of-fold scores, best first: a small search."""
    cards = [log_loss(out_of_fold(p, rows, k)).withColumn("name", F.lit(name)) for name, p in candidates.items()]
    return reduce(DataFrame.union, cards).select("name", "log_loss").orderBy("log_loss", "name")


def nested_search(rows: DataFrame, columns: list[str], outer: int = 5, inner: int = 3, depths: tuple = (2, 3), rounds: tuple = (5, 15), seed: int = 1) -> DataFrame:
    """(fold, depth, rounds, inner_loss, log_loss, roc_auc): for each outer fold the parameters that inner folds of the other rows choose, and how they do on the fold.

    ``rows`` (row_id, y, *columns). The grid's models of an inner search are fitted side by side;
    the fold that scores them takes no part in the choice.
    """
    spark, dealt = rows.sparkSession, written(folds(rows, outer), "outer")
    scores, picks = [], []
    for f in range(outer):
        rest = folds(dealt.where(F.col("fold") != f).drop("fold"), inner, seed=7 + f)
        pipeline = trees(columns, seed=seed)
        model = pipeline.getStages()[-1]
        grid = ParamGridBuilder().addGrid(model.maxDepth, list(depths)).addGrid(model.maxIter, list(rounds)).build()
        loss = MulticlassClassificationEvaluator(metricName="logLoss", labelCol="y")
        search = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=loss, numFolds=inner, foldCol="fold", parallelism=4, seed=seed)
        found = search.fit(rest)
        best = min(range(len(grid)), key=lambda k: (found.avgMetrics[k], k))  # noqa: B023
        picks.append((f, int(grid[best][model.maxDepth]), int(grid[best][model.maxIter]), float(found.avgMetrics[best])))
        held = scored(found.bestModel, dealt.where(F.col("fold") == f))
        scores.append(log_loss(held).crossJoin(roc_auc(held)).withColumn("fold", F.lit(f)))
    chosen = spark.createDataFrame(picks, "fold int, depth int, rounds int, inner_loss double")
    return chosen.join(reduce(DataFrame.union, scores), "fold").select("fold", "depth", "rounds", "inner_loss", "log_loss", "roc_auc")


def skew(model: Pipeline, context: DataFrame, alone: DataFrame, k: int = 5) -> DataFrame:
    """(auc_in_context, auc_alone): a model fitted on features in context, scoring each fold on those and on features of each row by itself.

    ``context`` and ``alone`` (row_id, y, ..) hold the same rows.
    """
    dealt = written(folds(context, k), "context")
    paired = written(alone.join(dealt.select("row_id", "fold"), "row_id"), "alone")
    both: list[list[DataFrame]] = [[], []]
    for f in range(k):
        fitted = model.fit(dealt.where(F.col("fold") != f))
        for out, rows in zip(both, (dealt, paired)):
            out.append(scored(fitted, rows.where(F.col("fold") == f)).select("row_id", "y", "p"))
    a, b = (roc_auc(written(reduce(DataFrame.union, x), "scores")).withColumnRenamed("roc_auc", n) for x, n in zip(both, ("auc_in_context", "auc_alone")))
    return a.crossJoin(b)


def calibrated(held: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with p made monotone to the shares of 1 among ``held`` (y, p)."""
    model = IsotonicRegression(featuresCol="p", labelCol="y").fit(held.select("p", F.col("y").cast("double").alias("y")))
    return model.transform(rows).withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("prediction")


def importances(model, columns: list[str], spark) -> DataFrame:
    """(feature, importance) of a fitted tree pipeline, largest first."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(columns, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def attributed(model, rows: DataFrame, columns: list[str], key: str, k: int = 5) -> DataFrame:
    """(key, p, top): the k features that move a row's p most when they are set to their mean, signed, by absolute size."""
    means = rows.agg(*[F.avg(c).alias(c) for c in columns]).first()
    out = scored(model, rows.select(key, *columns)).select(key, *columns, "p")
    for c in columns:
        # the same rows once more with one column replaced, so that nothing has to be joined
        moved = model.transform(out.withColumns({"own_": F.col(c), c: F.lit(float(means[c] or 0.0))}))
        out = moved.select(*[F.col("own_").alias(x) if x == c else F.col(x) for x in out.columns], vector_to_array("probability")[1].alias(f"p_{c}"))
    return out.select(key, "p", top_by_size({c: F.col("p") - F.col(f"p_{c}") for c in columns}, k).alias("top"))


def top_by_size(parts: dict, k: int):
    """The k largest of named numbers by absolute size (then name), as an array of (feature, value)."""
    all_ = F.array(*[F.struct((-F.abs(v)).alias("order"), F.lit(n).alias("feature"), v.alias("value")) for n, v in parts.items()])
    return F.transform(F.slice(F.array_sort(all_), 1, k), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value")))
