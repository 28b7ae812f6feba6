"""Bounded samples of labelled rows, for the models that are fitted on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.llm.common import forget, written


def fold(row_id: str, parts: int) -> Column:
    """Remainder of the crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(row_id).cast("string")) % parts


@dataclass
class Sample:
    """Texts and labels of a sample, and how many rows of each label there were to draw from."""

    texts: list[str]
    labels: list
    counts: dict


#: Code points of a piece, of which a text beyond the budget is sampled.
PIECE = 4096


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: dict | int, text: str = "text", row_id: str = "doc_id", most: int = 48 << 20) -> Sample:
    """At most ``per_class`` labelled documents of each label, drawn by a hash of the id.

    ``train`` says of a row of ``labels`` whether it may be learned from. Each
    label has its share of ``most`` code points, so that the sample is bounded in
    bytes too; both bounds concern fitting alone. Texts are taken in the order of
    the hash, whatever their length; of one that is longer than what is left of
    the share, pieces of ``PIECE`` code points are drawn by their hash. Null
    labels, null texts and ids that are labelled twice differently are left out;
    repeated texts and near copies (the same three least hashes of word pairs)
    count once. The documents are read once; what is drawn is written to the
    shared folder.
    """
    spark = docs.sparkSession
    key, said = F.col(f"`{row_id}`").cast("long"), F.col(f"`{label}`")
    ids = labels.where(said.isNotNull() & key.isNotNull() & train).groupBy(key.alias("id")).agg(F.min(said).alias("label"), F.max(said).alias("most"))
    ids = ids.where("label = most").select("id", "label")
    counts = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    wanted = lambda c: per_class if isinstance(per_class, int) else per_class.get(c, 0)
    draw = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) / F.lit(1 << 30)
    share = F.lit(0.0)
    for c, n in counts.items():
        share = F.when(F.col("label") == c, F.lit(min(1.0, wanted(c) / n))).otherwise(share)
    few = ids.withColumn("draw", draw).where(F.col("draw") < share)  # about the sum of per_class rows, whatever the input
    drawn = docs.select(key.alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(few), "id")
    held = written(drawn.withColumns({"row": F.monotonically_increasing_id(), "size": F.char_length("text")}), "sample")
    sizes = held.select("row", "label", "draw", "id", "size").toPandas().sort_values(["draw", "id", "size", "row"])
    sizes["room"] = most // max(1, len(counts)) - (sizes.groupby("label")["size"].cumsum() - sizes["size"])
    fits = spark.createDataFrame(sizes.loc[sizes["room"] > 0, ["row", "room"]], "row long, room long")
    # Of a text that is too long so many pieces as there is room for, in their order.
    n = F.ceil(F.col("size") / PIECE)
    pieces = F.filter(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda _, k: F.pmod(F.xxhash64(F.lit(13), "id", k), n) < F.ceil(F.col("room") / PIECE))
    taken = F.when(F.col("size") <= F.col("room"), F.col("text")).otherwise(F.substring(F.array_join(pieces, ""), F.lit(1), F.col("room").cast("int")))
    frame = held.join(F.broadcast(fits), "row").select("id", "label", taken.alias("text")).toPandas().sort_values(["id", "text"])
    forget(spark, held)
    return _distinct(frame, counts)


def _distinct(frame: pd.DataFrame, counts: dict) -> Sample:
    seen, texts, labels = set(), [], []
    for label, text in zip(frame["label"], frame["text"], strict=True):
        words = text.encode().lower().split()
        sign = tuple(islice(sorted({crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)}), 3)) or text
        if sign not in seen:
            seen.add(sign)
            texts.append(text)
            labels.append(label)
    return Sample(texts, labels, counts)
