"""Quality of a text by supervised subword embeddings.

Hashed words and character n-grams have learned vectors; a document is their
mean, and a softmax layer tells good from poor. Trained by stochastic gradient
descent in numpy. To score, vectors and output layer are multiplied out once,
so a text costs one table look-up for each of its features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysheet.llm.common import small_batches
from tallysheet.llm.hashing import counted, hashed
from tallysheet.llm.training import Sample, fold, labelled_sample

SIZES, BITS, DIMENSION = (2, 3, 4), 17, 12
#: Documents of each label to fit on, passes over them, first learning rate.
FITTED, PASSES, RATE = {1: 3000, 0: 2500}, 5, 1.0
BUCKETS = 1 << BITS


@dataclass
class QualityModel:
    """``table``: what a feature adds to the logit, its vector times the difference of the output rows."""

    table: np.ndarray
    bias: float

    @classmethod
    def fit(cls, sample: Sample, seed: int = 3) -> QualityModel:
        n1, n0 = sample.counts.get(1, 0), sample.counts.get(0, 0)
        y = np.array(sample.labels, np.int64)
        if not 0 < y.sum() < len(y):
            return cls(np.zeros(BUCKETS, np.float32), float(np.log((n1 + 0.5) / (n0 + 0.5))))
        rng = np.random.default_rng(seed)
        rows = [(found, n / max(1.0, n.sum())) for found, n in (counted(t, SIZES, BITS, words=True) for t in sample.texts)]
        vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSION)).astype(np.float32) / DIMENSION
        out, bias = np.zeros((2, DIMENSION)), np.zeros(2)
        steps, done = PASSES * len(rows), 0
        for _ in range(PASSES):
            for k in rng.permutation(len(rows)):
                found, share = rows[k]
                mean = share @ vectors[found]
                logits = out @ mean + bias
                e = np.exp(logits - logits.max())
                g = e / e.sum()
                g[y[k]] -= 1
                rate = RATE * (1 - done / steps)
                back = out.T @ g
                out -= rate * np.outer(g, mean)
                bias -= rate * 0.1 * g
                # The mean spreads a gradient thinly over many features; scaled up by their number it moves them like words of a short text.
                vectors[found] -= (rate * min(len(found), 50)) * np.outer(share, back).astype(np.float32)
                done += 1
        # Labels were drawn at different rates: move the bias to the rates of all labelled rows.
        shift = np.log((n1 + 0.5) / (n0 + 0.5)) - np.log(y.sum() / (len(y) - y.sum()))
        return cls((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0] + shift))

    def score(self, text: str | None) -> float:
        """Probability of label 1 for a whole text; an empty text has the bias alone."""
        total, n = 0.0, 0
        for found in hashed(text or "", SIZES, BITS, words=True):
            total += float(self.table.take(found).sum(dtype=np.float64))
            n += len(found)
        return float(1 / (1 + np.exp(-np.clip(total / max(n, 1) + self.bias, -35, 35))))

    def column(self, spark: SparkSession, text: Column | str) -> Column:
        shared = spark.sparkContext.broadcast(self)
        small_batches(spark)

        @F.pandas_udf(T.DoubleType())
        def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = shared.value
            for batch in texts:
                yield pd.Series([model.score(t) for t in batch], dtype=float)

        return score(text)


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, fitted: dict | None = None, text: str = "text", row_id: str = "doc_id") -> QualityModel:
    """A model from the labelled documents for which ``train`` (on ``labels``) holds, ``fitted`` of each label at most."""
    return QualityModel.fit(labelled_sample(docs, labels, "quality", train, fitted or FITTED, text=text, row_id=row_id))


def score_documents(docs: DataFrame, model: QualityModel, text: str = "text", row_id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Empty and null texts get the score of the bias alone. Rows alike score
    alike; a null id counts as not held out; an empty table gives no rows;
    further columns are ignored.
    """
    scored = docs.select(F.col(row_id).cast("long").alias("doc_id"), model.column(docs.sparkSession, F.col(text).cast("string")).alias("score"))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's score."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, fit_quality(docs, labels, fold("doc_id", 3) != 1))
