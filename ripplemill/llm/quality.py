"""Quality classifier: hashed word n-gram logistic regression, learnt by following the regularised leader.

A document is the shares of its hashed one- and two-word grams, and its score the sigmoid
of one sparse dot product with the weights. Only words count: a null, empty or blank text
has no grams and scores as the model's bias. Repeated rows score alike; other columns are
ignored. Without any label the model is empty and every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import MAX_TRAINING_DOCS, fit, held_out, keep_rows, score_rows, training_docs
from .linear import SIZE, Ftrl, ngrams, score_quality, sparse, train_quality

THRESHOLD = 0.7
MODULUS, REMAINDER = 4, 2


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS, passes: int = 4) -> Ftrl:
    sample = training_docs(docs, labels, "quality", held_out(F.col("doc_id"), MODULUS, REMAINDER), max_docs)

    def examples(texts):
        buckets, start = ngrams(texts)
        return [(i, x.astype(np.float32)) for i, x in (sparse(buckets[a:b]) for a, b in zip(start, start[1:]))]

    return fit(sample, examples, train_quality, Ftrl(0.5, 1.0, 0.1, 0.0), passes)


def scorer(spark, model: Ftrl):
    shared = spark.sparkContext.broadcast((model.weights()[:SIZE].astype(np.float64), model.bias()))

    def start():
        w, b = shared.value
        return lambda texts: [pa.array(score_quality(w, b, texts))]

    return start


def score(docs: DataFrame, model: Ftrl) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    rows = score_rows(docs, scorer(docs.sparkSession, model))
    return rows.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Ftrl, at_least: float = THRESHOLD) -> DataFrame:
    return keep_rows(docs, scorer(docs.sparkSession, model), at_least)
