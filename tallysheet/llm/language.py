"""Language of a text: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Trained by follow-the-regularised-leader with an elastic net penalty, then
calibrated by a temperature on documents kept back from the training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.llm.common import small_batches
from tallysheet.llm.hashing import counted, hashed
from tallysheet.llm.training import Sample, fold, labelled_sample

SIZES, BITS = (1, 2, 3, 4), 16
#: Documents of each language to fit on, passes over them, learning rate, L1 and L2 penalties, scale of the features.
FITTED, PASSES, RATE, L1, L2, SCALE = 1500, 3, 0.5, 0.02, 0.001, 20.0
#: Given to texts without letters.
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}").search


@dataclass
class LanguageModel:
    """``table`` holds weight times inverse document frequency by bucket and language."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    @classmethod
    def fit(cls, sample: Sample, seed: int = 5) -> LanguageModel:
        languages = sorted(set(sample.labels))
        if not languages:
            return cls([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
        rows = [counted(t.lower(), SIZES, BITS) for t in sample.texts]
        y = np.array([languages.index(x) for x in sample.labels])
        held_by = np.zeros(1 << BITS)
        for found, _ in rows:
            held_by[found] += 1
        idf = np.log((len(rows) + 1) / (held_by + 1)) + 1
        rows = [(found, n / n.sum() * idf[found] * SCALE) for found, n in rows]
        order = np.random.default_rng(seed).permutation(len(rows))
        kept = order[: len(rows) // 5] if len(rows) >= 50 else order[:0]
        z, n2 = np.zeros((1 << BITS, len(languages))), np.zeros((1 << BITS, len(languages)))
        zb, nb = np.zeros(len(languages)), np.zeros(len(languages))

        def weights(z: np.ndarray, n2: np.ndarray, l1: float) -> np.ndarray:
            return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n2)) / RATE + L2))

        for _ in range(PASSES):
            for k in order[len(kept) :]:
                found, x = rows[k]
                w, b = weights(z[found], n2[found], L1), weights(zb, nb, 0.0)
                g = softmax(x @ w + b)
                g[y[k]] -= 1
                step = x[:, None] * g
                grown = n2[found] + step * step
                z[found] += step - (np.sqrt(grown) - np.sqrt(n2[found])) / RATE * w
                n2[found] = grown
                grown = nb + g * g
                zb, nb = zb + g - (np.sqrt(grown) - np.sqrt(nb)) / RATE * b, grown
        w, b = weights(z, n2, L1), weights(zb, nb, 0.0)
        temperature = 1.0
        if len(kept):
            raw = np.stack([rows[k][1] @ w[rows[k][0]] + b for k in kept])
            loss = lambda t: -np.log(np.maximum(softmax(raw / t)[np.arange(len(kept)), y[kept]], 1e-12)).mean()
            temperature = float(min(np.geomspace(0.05, 20, 241), key=loss))
        return cls(languages, (w * idf[:, None] * SCALE).astype(np.float32), b, temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability of a whole text; texts without letters are undetermined, with certainty."""
        if not text or not LETTER(text):
            return UNDETERMINED, 1.0
        if not self.languages:
            return UNDETERMINED, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for found in hashed(text.lower(), SIZES, BITS):
            total += self.table.take(found, axis=0).sum(axis=0, dtype=np.float64)
            n += len(found)
        p = softmax((total / n + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])

    def column(self, spark: SparkSession, text: Column | str) -> Column:
        """``struct<lang_pred, score>`` of a text."""
        shared = spark.sparkContext.broadcast(self)
        small_batches(spark)

        @F.pandas_udf("lang_pred string, score double")
        def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = shared.value
            for batch in texts:
                yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang_pred", "score"])

        return predicted(text)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_language(docs: DataFrame, train: Column, fitted: int = FITTED, text: str = "text", lang: str = "lang", row_id: str = "doc_id") -> LanguageModel:
    """A model from the documents with a language for which ``train`` holds, ``fitted`` of each language at most."""
    return LanguageModel.fit(labelled_sample(docs, docs, lang, train, fitted, text=text, row_id=row_id))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    Null texts and texts without letters are ``und`` with score 1; without any
    learned language every text is ``und`` with score 0. Rows alike get the same
    result; a null id counts as not held out; an empty table gives no rows;
    further columns are ignored.
    """
    found = docs.select(F.col(row_id).cast("long").alias("doc_id"), model.column(docs.sparkSession, F.col(text).cast("string")).alias("found"))
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "found.lang_pred", "found.score")


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document's language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit_language(docs, fold("doc_id", 4) != 2))
