"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A sentence's log-odds are a floor and the weights of its words and of their beginnings; a
document is toxic if any sentence is, so its score is the noisy-or of its sentences. The
gradient of a document's label reaches each sentence in proportion to what noisy-or owes
it, which lets the model find the sentences at fault though none is labelled.

A null, empty or wordless text has no sentence and scores 0. Repeated rows score alike;
other columns are ignored. Without labels every weight is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import MAX_TRAINING_DOCS, fit, held_out, score_rows, training_docs
from .linear import SIZE, Ftrl, WordWeights, score_toxic, toxic_examples, train_toxic

THRESHOLD = 0.5
MODULUS, REMAINDER = 5, 0


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS, passes: int = 4) -> Ftrl:
    sample = training_docs(docs, labels, "toxic", held_out(F.col("doc_id"), MODULUS, REMAINDER), max_docs)

    def examples(texts):
        return [(a.astype(np.int32), b.astype(np.int32)) for a, b in toxic_examples(texts)]

    return fit(sample, examples, train_toxic, Ftrl(2.0, 1.0, 0.5, 0.0), passes)


def score(docs: DataFrame, model: Ftrl) -> DataFrame:
    """doc_id, held_out, score, predicted, and the numbers (from 0) of the sentences that score 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights()[:SIZE])

    def start():
        weights = WordWeights(shared.value)

        def of(texts):
            points, each = score_toxic(weights, texts)
            return [pa.array(points), pa.array([np.flatnonzero(p >= THRESHOLD).astype(np.int32).tolist() for p in each], pa.list_(pa.int32()))]

        return of

    rows = score_rows(docs, start, ", toxic_sentences array<int>")
    return rows.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "toxic_sentences")
