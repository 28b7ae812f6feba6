"""Exact duplicates by a persistent digest index.

The index is a Parquet table bucketed and sorted by the digest. A batch is
reduced to one row per digest, dropped where a sort-merge anti-join finds the
digest in the index, and what is new is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.llm.common import WS, delete, forget, new_path, row_key, rows_of, text_or_empty, written


def normalised(text: str = "text") -> Column:
    """Text without any ASCII white space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), WS + "+", "")


class DigestIndex:
    """Digests of all texts seen so far, with the id of the row that stays.

    ``path`` names the folder of an index that outlives the session; without it
    the table lies in a folder of its own among the shared ones until
    :meth:`drop`. The warehouse is never written to. ``buckets`` should be so many that one bucket of digests
    (about 40 bytes a row) sorts in memory. Each batch adds a file to a bucket;
    :meth:`compact` makes them one again, so that they are read as sorted.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.own = path is None
        self.path = path or new_path(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING)"
            f" USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _save(self, rows: DataFrame, mode: str) -> None:
        writer = rows.repartition(self.buckets, "digest").write.mode(mode).format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", self.path) if mode == "overwrite" else writer).saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def add(self, representatives: DataFrame) -> None:
        """Append the rows (digest, keep_id, batch) whose digest the index lacks."""
        new = representatives.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        # Written out first: a table can't be read and appended to in one job.
        new = written(new.select("digest", "keep_id", "batch"), "new-digests")
        self._save(new, "append")
        forget(self.spark, new)

    def compact(self) -> None:
        """Rewrite the index with one sorted file a bucket; the rows lie in the shared folder until that has succeeded."""
        held = written(self.rows(), "index")
        self._save(held, "overwrite")
        forget(self.spark, held)

    def drop(self) -> None:
        """Forget the table; the files under a ``path`` that was given stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if self.own:
            delete(self.spark, self.path)

    def _held(self, docs: DataFrame, text: str, row_id: str, batch: str | None) -> tuple[DataFrame, DataFrame]:
        """The rows of a batch by digest, and for each of its digests the row that stays, after it is added to the index."""
        batch = batch or uuid.uuid4().hex
        none, number, digest = row_key(text, row_id)
        tagged = written(
            docs.select(
                none.alias("none"),
                number.alias("id"),
                digest.alias("hash"),
                F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
                F.char_length(text_or_empty(text)).alias("chars"),
                F.monotonically_increasing_id().alias("row"),
            ),
            "digests",
        )
        best = F.min(F.struct((-F.col("chars")).alias("chars"), "none", "id", "hash", "row")).alias("best")
        groups = written(tagged.groupBy("digest").agg(best, F.count("*").alias("group_size")).select("digest", "group_size", "best"), "digest-groups")
        self.add(groups.select("digest", F.when(~F.col("best.none"), F.col("best.id")).alias("keep_id"), F.lit(batch).alias("batch")))
        # Written, so that both sides of the last join are shuffled and a text with very many copies can be split.
        own = F.when(F.col("batch") == batch, F.col("best")).alias("best")
        held = written(groups.join(self.rows().hint("merge"), "digest").select("digest", "group_size", "keep_id", own), "held")
        forget(self.spark, groups)
        return tagged, held

    def classify(self, docs: DataFrame, text: str = "text", row_id: str = "doc_id", batch: str | None = None) -> DataFrame:
        """Add a batch to the index; one row per input row.

        Returns ``doc_id, keep_id, group_size, kept, text_sha256``. In a batch
        the row with most code points stays, then the smallest id (null ids
        last), then any one of rows alike in both; a text that an earlier batch
        brought stays with that batch's row. A batch that is named and run again
        under its name, after it was lost on the way, keeps its rows.
        ``group_size`` counts the rows of this batch. Null text counts as empty;
        an empty table gives no rows; further columns are ignored.
        """
        tagged, held = self._held(docs, text, row_id, batch)
        return tagged.join(held, "digest").select(
            F.when(~F.col("none"), F.col("id")).alias("doc_id"),
            "keep_id",
            "group_size",
            F.coalesce(F.col("row") == F.col("best.row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def deduplicate(self, docs: DataFrame, text: str = "text", row_id: str = "doc_id", batch: str | None = None) -> DataFrame:
        """Rows of ``docs`` that stay, all their columns as they were; see :meth:`classify`.

        Rows alike in id and text count as copies of each other.
        """
        _, held = self._held(docs, text, row_id, batch)
        return rows_of(docs, held.where("best IS NOT NULL").select("best.none", "best.id", "best.hash"), text, row_id)


def dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document with the row that stays for its text."""
    index = DigestIndex(spark)
    found = index.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    index.drop()  # the result reads written files alone
    return found


DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
