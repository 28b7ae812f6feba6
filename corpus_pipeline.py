"""A training corpus from documents, in stages that each read what the one before wrote.

Toxic documents go, then exact copies, then near copies; the rest is mixed to
target weights and encoded. Every stage but the last returns the columns of
``documents``; mixing returns a document as often as the mix takes it, so ids
repeat after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallysheet.llm import bpe, exact_dedup, mixing, simhash, toxicity
from tallysheet.llm.common import forget, settled
from tallysheet.llm.training import fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from labelled documents of the stage's input. Without labels of both kinds all score the share of toxic rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit_toxicity(docs, labels, fold("doc_id", 4) != 2))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    index = exact_dedup.DigestIndex(spark)
    kept = index.deduplicate(docs)
    index.drop()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; one without an id only where the group has none."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents of the mix, one row for each time one is taken."""
    return bpe.digests(bpe.encode_documents(docs, bpe.default_vocabulary()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Scores, fingerprints and tokens are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each but the last written to the shared folder.

    What a stage wrote on its way, and the documents of the stage before, are
    deleted when its result is written.
    """
    docs, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), False
    for name, stage in STAGES[:-1]:
        found = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if own:
            forget(spark, docs)
        docs, own = found, True
    return STAGES[-1][1](spark, docs, sf_dir)
