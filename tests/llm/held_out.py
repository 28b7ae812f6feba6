"""Prints how well the classifiers do on the rows that their queries hold back: ``python -m tests.llm.held_out SF_DIR``."""

import sys

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from tallysheet.llm import language, quality, toxicity


def area(score, truth):
    """Area under the curve, ties averaged."""
    rank = pd.Series(score).rank().to_numpy()
    good = truth.sum()
    return (rank[truth].sum() - good * (good + 1) / 2) / (good * (len(truth) - good))


def main(folder: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = language.language_query(spark, folder).where("held_out").join(documents.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").toPandas()
    print(f"language: {len(found)} rows, accuracy {(found.lang == found.lang_pred).mean():.4f}")
    for name, query, label in (("toxicity", toxicity.toxicity_query, "toxic"), ("quality", quality.quality_query, "quality")):
        found = query(spark, folder).where("held_out").join(labels.select("doc_id", label), "doc_id").where(f"{label} IS NOT NULL").toPandas()
        truth, said = (found[label] == 1).to_numpy(), (found.predicted == 1).to_numpy()
        hit = np.sum(truth & said)
        print(f"{name}: {len(found)} rows, base rate {truth.mean():.3f}, accuracy {(truth == said).mean():.3f}, precision {hit / said.sum():.3f}, recall {hit / truth.sum():.3f}, "
              f"of label 0 said 1 {(said & ~truth).sum() / (~truth).sum():.3f}, area {area(found.score, truth):.3f}")  # fmt: skip
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
