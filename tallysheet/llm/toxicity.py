"""Toxicity by compression distance with two zstandard dictionaries.

One dictionary is trained by zstandard on windows of ordinary text, one on
windows of toxic text. A text is cut into windows of a few words; a window is
compressed with the ordinary dictionary alone and with the toxic one behind it,
and the bytes that the toxic dictionary saves are its gain. Counts of windows
over gain thresholds go through a logistic calibration to a score.

Only whole documents are labelled, and most windows of a toxic document are
ordinary. Which of them the toxic dictionary learns from is settled in rounds:
first runs of words that the ordinary dictionary compresses worst, then windows
that a dictionary trained on *other* toxic documents compresses better by so many
bytes as windows of ordinary documents seldom gain, and of these in the end only
the run of words that carries the gain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysheet.llm.common import fresh, small_batches
from tallysheet.llm.training import Sample, fold, labelled_sample

#: Words in a window, and in the run of it that is learned from in the end.
WINDOW, RUN = 8, 2
#: Bytes of the ordinary and the toxic dictionary, lengths of the segments that zstandard makes them of.
ORDINARY_BYTES, TOXIC_BYTES, ORDINARY_SEGMENT, TOXIC_SEGMENT = 112_640, 2_048, 64, 16
#: Windows (about, drawn by their hash) of ordinary text that the ordinary dictionary is trained on.
ORDINARY_WINDOWS = 150_000
#: Parts of the sample that learn from the others; rounds; rounds that learn from whole windows; runs of a document to begin with.
FOLDS, ROUNDS, WHOLE, FIRST = 4, 6, 3, 6
#: A gain tells if windows of toxic documents reach it so many times as often as those of ordinary ones; bytes that a run must carry.
LIFT, CARRIED = 3.0, 3
#: Windows that are cut into runs at a time.
AT_ONCE = 10_000
#: Gains that features count, in bytes; greater gains than the last count as that.
GAINS, MOST_GAIN = (1, 2, 3, 4, 5, 6, 8), 11
#: Documents to fit on: toxic, ordinary.
FITTED = {1: 3000, 0: 5000}


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Runs of ``size`` words of the whole text, A to Z in lower case, a space before each word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return [b" " + b" ".join(words[i : i + size]) for i in range(0, len(words), size)]


def trained(parts: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary that zstandard trains on the parts; their end itself where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, parts, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:].rjust(8)


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor whose frames have no header to speak of, so that lengths tell the content apart.

    Parsing is optimal: a greedy parse varies by more bytes than a toxic word saves.
    """
    parameters = zstandard.ZstdCompressionParameters.from_level(
        6, strategy=zstandard.STRATEGY_BTOPT, min_match=5, search_log=8, hash_log=17, chain_log=17, window_log=18,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=parameters)


def lengths(with_: zstandard.ZstdCompressor, parts: list[bytes], threads: int = 1) -> np.ndarray:
    """Compressed length of each part by itself."""
    if not parts:
        return np.zeros(0, np.int64)
    out = with_.multi_compress_to_buffer(parts, threads=threads)
    return np.fromiter((len(out[k]) for k in range(len(parts))), np.int64, len(parts))


def best_of_each(score: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each group."""
    order = np.lexsort((-score, group))
    new = np.append(True, np.diff(group[order]) != 0) if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < k]


class Windows:
    """Windows of some texts, and the text each is of."""

    def __init__(self, texts: list[str]):
        held = [windows(t) for t in texts]
        self.texts = len(texts)
        self.of = np.repeat(np.arange(len(held)), [len(h) for h in held])
        self.parts = [w + b" " for h in held for w in h]

    def greatest(self, gains: np.ndarray) -> np.ndarray:
        """The greatest gain of each text, 0 for a text without windows or gains."""
        out = np.zeros(self.texts, np.int64)
        np.maximum.at(out, self.of, gains)
        return out

    def counts(self, gains: np.ndarray) -> np.ndarray:
        """For each text how many of its windows have each gain."""
        out = np.zeros((self.texts, MOST_GAIN + 1))
        np.add.at(out, (self.of, np.clip(gains, 0, MOST_GAIN)), 1)
        return out


def runs_of(parts: list[bytes]) -> Iterator[tuple[slice, list[bytes], list[bytes], np.ndarray]]:
    """Some windows at a time: runs of :data:`RUN` words of each, what is left of the window without each, and which window it was."""
    for start in range(0, len(parts), AT_ONCE):
        runs, rest, of = [], [], []
        for n, part in enumerate(parts[start : start + AT_ONCE]):
            words = part.split()
            for i in range(max(1, len(words) - RUN + 1)):
                runs.append(b" " + b" ".join(words[i : i + RUN]) + b" ")
                rest.append(b" " + b" ".join(words[:i] + words[i + RUN :]) + b" ")
                of.append(n)
        yield slice(start, start + AT_ONCE), runs, rest, np.array(of, np.int64)


def sizes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter((len(p) for p in parts), np.float64, len(parts))


def carriers(plain: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor, parts: list[bytes]) -> list[bytes]:
    """Of each window the run that carries most of its gain, if it carries enough."""
    gain = lambda some: lengths(plain, some, -1) - lengths(toxic, some, -1)
    out: list[bytes] = []
    for some, runs, rest, of in runs_of(parts):
        carried = gain(parts[some])[of] - gain(rest)
        out += [runs[k] for k in best_of_each(carried - sizes(runs) / 1000, of, 1) if carried[k] >= CARRIED]
    return out


def costly(plain: zstandard.ZstdCompressor, held: Windows, cost: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Of each text the runs that take most bytes for their length, one of a window, and whose they are."""
    found: list[bytes] = []
    dearest = []
    for some, runs, rest, of in runs_of(held.parts):
        dear = (cost[some][of] - lengths(plain, rest, -1)) / sizes(runs)
        best = best_of_each(dear, of, 1)
        found += [runs[k] for k in best]
        dearest.append(dear[best])
    best = best_of_each(np.concatenate(dearest), held.of, FIRST)
    return [found[k] for k in best], held.of[best]


def separation(toxic: np.ndarray, ordinary: np.ndarray) -> float:
    """How often a toxic text has a greater greatest gain than an ordinary one, ties by half."""
    least = min(toxic.min(), ordinary.min())
    a, b = (np.bincount(np.minimum(x - least, 64), minlength=65) for x in (toxic, ordinary))
    return float((a * (np.cumsum(b) - b / 2)).sum() / (len(toxic) * len(ordinary)))


def toxic_dictionary(base: bytes, toxic: Windows, ordinary: Windows) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The toxic dictionary, and the gains of the toxic and ordinary windows by dictionaries that haven't seen their texts.

    The dictionary is that of the round in which the parts' dictionaries told
    the texts of the other parts apart best.
    """
    plain = compressor(base)
    cost, ordinary_cost = lengths(plain, toxic.parts, -1), lengths(plain, ordinary.parts, -1)
    part, ordinary_part = toxic.of % FOLDS, ordinary.of % FOLDS
    runs, of = costly(plain, toxic, cost)
    learned = [[r for r, text in zip(runs, of, strict=True) if text % FOLDS == k] for k in range(FOLDS)]
    gain, ordinary_gain = np.zeros(len(cost), np.int64), np.zeros(len(ordinary_cost), np.int64)
    best: tuple[float, list[bytes], np.ndarray] = (-1.0, [], gain)
    for turn in range(ROUNDS):
        others = [compressor(base + trained([p for j in range(FOLDS) if j != k for p in learned[j]], TOXIC_BYTES, TOXIC_SEGMENT)) for k in range(FOLDS)]
        for k, other in enumerate(others):
            own, ordinary_own = np.flatnonzero(part == k), np.flatnonzero(ordinary_part == k)
            gain[own] = cost[own] - lengths(other, [toxic.parts[i] for i in own], -1)
            ordinary_gain[ordinary_own] = ordinary_cost[ordinary_own] - lengths(other, [ordinary.parts[i] for i in ordinary_own], -1)
        apart = separation(toxic.greatest(gain), ordinary.greatest(ordinary_gain))
        if apart > best[0]:
            best = apart, [p for parts in learned for p in parts], gain.copy()
        # The least gain that tells, or the most telling; a few ordinary windows more than met, since none met proves little.
        met = {g: int((gain >= g).sum()) for g in range(1, MOST_GAIN + 1)}
        lift = {g: n / len(gain) / (((ordinary_gain >= g).sum() + 5) / len(ordinary_gain)) for g, n in met.items()}
        least = next((g for g in lift if lift[g] >= LIFT), max(lift, key=lambda g: met[g] * math.log(max(lift[g], 1e-9))))
        for k, other in enumerate(others):
            found = [toxic.parts[i] for i in np.flatnonzero((part == k) & (gain >= least))]
            learned[k] = carriers(plain, other, found) if turn >= WHOLE - 1 else found
    toxic_bytes = trained(best[1], TOXIC_BYTES, TOXIC_SEGMENT)
    # No ordinary text was learned from, so the dictionary itself tells what they gain.
    return toxic_bytes, best[2], ordinary_cost - lengths(compressor(base + toxic_bytes), ordinary.parts, -1)


class Gains:
    """Bytes that the toxic dictionary saves on each window of a text, as counts by gain."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = compressor(ordinary), compressor(ordinary + toxic)

    def counts(self, text: str | None) -> np.ndarray:
        held = Windows([text or ""])
        return held.counts(lengths(self.ordinary, held.parts) - lengths(self.toxic, held.parts))[0]


def features(counts: np.ndarray) -> np.ndarray:
    """For each text its windows, how many reach each gain, their share, and the greatest gain."""
    n = np.maximum(counts.sum(axis=1), 1)
    over = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    columns = [np.log1p(n)]
    for k in GAINS:
        columns += [np.log1p(over[:, k]), np.minimum(over[:, k] / n * 20, 3)]
    return np.stack(columns + [(over[:, k] > 0).astype(float) for k in range(1, 9)], axis=1)


@dataclass
class ToxicityModel:
    """Two dictionaries and the calibration of their gains; a few hundred kilobytes."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    @classmethod
    def fit(cls, sample: Sample) -> ToxicityModel:
        """Learn from a sample; without both labels the score is the share of toxic rows everywhere, next to 0 if nothing is labelled."""
        by_label = [Windows([t for t, y in zip(sample.texts, sample.labels, strict=True) if y == label]) for label in (0, 1)]
        ordinary_windows, toxic_windows = by_label
        n1, n0 = float(sample.counts.get(1, 0)), float(sample.counts.get(0, 0))
        prior = (n1 + 1e-6) / (n1 + n0 + 1)
        if not ordinary_windows.parts or not toxic_windows.parts:
            width = features(np.zeros((1, MOST_GAIN + 1))).shape[1]
            return cls(b" " * 8, b" " * 8, np.zeros(width), np.ones(width), np.append(np.zeros(width), math.log(prior / (1 - prior))), prior)
        drawn = ORDINARY_WINDOWS / len(ordinary_windows.parts) * (1 << 32)
        ordinary = trained([p for p in ordinary_windows.parts if crc32(p) < drawn], ORDINARY_BYTES, ORDINARY_SEGMENT)
        toxic, gain, ordinary_gain = toxic_dictionary(ordinary, toxic_windows, ordinary_windows)
        x = features(np.concatenate([ordinary_windows.counts(ordinary_gain), toxic_windows.counts(gain)]))
        y = np.repeat([0.0, 1.0], [ordinary_windows.texts, toxic_windows.texts])
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        weights = np.zeros(x.shape[1])
        for _ in range(40):  # Newton steps of a ridge-penalised logistic regression
            p = 1 / (1 + np.exp(-x @ weights))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(weights)), x.T @ (p - y) + 0.5 * weights)
            weights -= step
            if np.abs(step).max() < 1e-8:
                break
        # Classes were drawn at different rates: move the intercept to the rates of all labelled rows.
        weights[-1] += math.log((n1 + 0.5) / (n0 + 0.5)) - math.log(y.sum() / (len(y) - y.sum()))
        return cls(ordinary, toxic, mean, scale, weights, prior)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        x = (features(counts) - self.mean) / self.scale
        # Row by row: a product of matrices would round rows alike in different ways.
        return 1 / (1 + np.exp(-np.clip((x * self.weights[:-1]).sum(axis=1) + self.weights[-1], -35, 35)))

    def column(self, spark: SparkSession, text: Column | str) -> Column:
        """Score of a whole text; null counts as empty, which scores as a text without telling windows."""
        shared = spark.sparkContext.broadcast(self)
        small_batches(spark)

        @F.pandas_udf(T.DoubleType())
        def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = shared.value
            gains = Gains(model.ordinary, model.toxic)
            for batch in texts:
                yield pd.Series(model.scores(np.stack([gains.counts(t) for t in batch])) if len(batch) else [], dtype=float)

        return score(text)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, fitted: dict | None = None, text: str = "text", row_id: str = "doc_id") -> ToxicityModel:
    """A model from the labelled documents for which ``train`` (on ``labels``) holds, ``fitted`` of each label at most."""
    return ToxicityModel.fit(labelled_sample(docs, labels, "toxic", train, fitted or FITTED, text=text, row_id=row_id))


def score_documents(docs: DataFrame, model: ToxicityModel, text: str = "text", row_id: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Empty and null texts get the score of a text in which nothing is found. Rows
    alike score alike; a null id counts as not held out; an empty table gives
    no rows; further columns are ignored.
    """
    scored = docs.select(F.col(row_id).cast("long").alias("doc_id"), model.column(docs.sparkSession, F.col(text).cast("string")).alias("score"))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, columns unchanged."""
    score = fresh(docs.columns, "score")[0]
    scored = docs.withColumn(score, model.column(docs.sparkSession, F.col(f"`{text}`").cast("string")))
    return scored.where(F.col(score) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document's score."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, fit_toxicity(docs, labels, fold("doc_id", 4) != 2))
