"""What the corpus operators share: the shared folder, written stages, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts: space and the five ASCII controls from tab to carriage return.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that a Python task gets at a time (about; a longer text is a batch by itself).
BATCH = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (a single-machine test session) a folder of the
    driver's own is chosen once per application and remembered in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tallysheet.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallysheet-")
        spark.conf.set("tallysheet.shared.dir", base)
    return base.rstrip("/")


#: Paths that this driver has written and not deleted.
_paths: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallysheet/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result has no lineage behind it: a lost executor costs a re-read of
    files, not a re-run of the stage, and non-deterministic ids stay fixed. The
    files stay until :func:`forget` or :func:`settled` deletes them; what the
    frame that an operator returns still reads is left to the caller, who may
    clear the folder ``tallysheet`` when the result is stored.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of frames made by :func:`written` that nothing reads any more."""
    for folder in {os.path.dirname(f) for df in frames for f in df.inputFiles()}:
        delete(spark, folder)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written; all that was written on the way to it is deleted."""
    known = len(_paths)
    out = written(make(), name)
    for folder in _paths[known:-1]:
        delete(spark, folder)
    del _paths[known:-1]
    return out


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that Python tasks get to :data:`BATCH` bytes, for the length of texts varies without limit.

    A setting of the session, since Spark reads it only when the returned frame
    is run; a smaller bound that the caller set stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < bound <= BATCH:
        spark.conf.set(key, str(BATCH))


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that none of the columns has, upper and lower case alike."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(text: str = "text", row_id: str = "doc_id") -> list[Column]:
    """What tells rows apart: whether the id is null, the id, a hash of the whole text. None of the three is null.

    Rows that agree in all three count as one row repeated.
    """
    number = F.col(f"`{row_id}`").cast("long")
    return [number.isNull(), F.coalesce(number, F.lit(0)), F.xxhash64(text_or_empty(text))]


def rows_of(docs: DataFrame, kept: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each key (``none, id, hash``) in ``kept``, all columns as they were.

    Texts are shuffled once: join and row number share their keys.
    """
    names = fresh(docs.columns, "none", "id", "hash", "kept_none", "kept_id", "kept_hash", "alike")
    own, other, alike = names[:3], names[3:6], names[6]
    keyed = docs.withColumns(dict(zip(own, row_key(text, row_id), strict=True)))
    kept = kept.select(*[F.col(c).alias(n) for c, n in zip(("none", "id", "hash"), other, strict=True)])
    found = keyed.join(kept, [F.col(a) == F.col(b) for a, b in zip(own, other, strict=True)], "left_semi")
    first = F.row_number().over(Window.partitionBy(*own).orderBy(own[2]))
    return found.withColumn(alike, first).where(F.col(alike) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def splittable(small: DataFrame) -> DataFrame:
    """An aggregate dealt out anew, so that both sides of a join with it are plain shuffles and a hot key of the other side can be split."""
    return small.repartition(int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every id that has an edge.

    ``edges`` has two columns of one orderable type, ``a`` and ``b``. Returns
    ``node, component``. Alternating large-star and small-star rounds; each is
    two grouped minimums and two joins on the node; the minimums are dealt out anew
    before they are joined, so that a hub is only a skewed join key that adaptive
    execution splits, never a group gathered in one task.
    Every round is written to the shared folder, which cuts the lineage.
    Self-loops are ignored; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    cur = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        # Large star: each neighbour above a node is linked to the node's smallest neighbour (or itself).
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(splittable(low), "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: neighbours below a node, and the node, are linked to the smallest of them.
        up = large.select(F.col("b").alias("a"), F.col("a").alias("b"))
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        linked = up.join(splittable(low), "a").where("b <> m").select(F.col("m").alias("a"), "b")
        nxt = written(linked.unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        # Done when every id hangs on one root and no root hangs on another.
        hung, roots = nxt.groupBy("b").agg(F.count("*").alias("n")), nxt.select(F.col("a").alias("b")).distinct()
        open_ = hung.where("n > 1").select("b").unionByName(hung.select("b").join(roots, "b", "left_semi")).limit(1).count()
        forget(spark, cur)
        cur = nxt
        if not open_:
            break
    else:
        raise RuntimeError("connected components did not settle")
    own = cur.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return cur.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(own)


def by_batch(frame: pd.DataFrame, rows: int):
    """Slices of at most ``rows`` rows, to bound what numpy holds at once."""
    for start in range(0, len(frame), rows):
        yield frame.iloc[start : start + rows]
