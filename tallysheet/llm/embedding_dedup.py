"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors at a cosine of t or more lie within sqrt(2 - 2t) of each other.
Their leading principal coordinates are cut into cells of that width, and the
vectors of a label sorted by cells. The sorted sequence is dealt out in blocks;
blocks whose cells or boxes lie too far apart never meet, and two blocks that
meet are halved again and again, parts that are provably distant being skipped,
until small parts are compared by their exact cosines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysheet.llm.common import connected_components, forget, small_batches, written
from tallysheet.llm.simhash import merge_labels

COSINE = 0.98
#: Principal coordinates in the grid, vectors in a block, vectors in a part that is compared outright.
AXES, BLOCK, LEAF = 6, 4096, 256
#: How the components of a block are packed.
PACKED = {"float": "<f4", "double": "<f8"}


def linkable(vector: str = "embedding") -> Column:
    """Whether a vector has a direction: no null and no non-finite component, and not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def units(vectors) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that no square over- or underflows."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def element(vectors: DataFrame) -> str:
    """``float`` if the vectors are of floats, which then need not be widened to be sent; else ``double``."""
    kind = vectors.schema["embedding"].dataType
    return "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal axes by vector length, from the second moments of all vectors.

    Each task sends one sum of outer products for each length it met, as packed
    rows that are added up row by row; only the total, a square of the
    dimension, comes to the driver.
    """

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for size, part in frame.groupby(frame["embedding"].map(len)):
                x = units(part["embedding"])
                x = np.column_stack([x, np.ones(len(x))])
                total[size] = total.get(size, 0) + x.T @ x
        for size, m in total.items():
            yield pd.DataFrame({"size": size, "line": np.arange(len(m)), "sums": [row.tobytes() for row in m]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in group["sums"])
        return pd.DataFrame({"size": group["size"].iloc[:1], "line": group["line"].iloc[:1], "sums": [total.tobytes()]})

    shape = "size int, line int, sums binary"
    sums = classes.select("embedding").mapInPandas(moments, shape).groupBy("size", "line").applyInPandas(added, shape)
    out = {}
    for size, part in sums.toPandas().groupby("size"):
        m = np.stack([np.frombuffer(b) for b in part.sort_values("line")["sums"]])
        mean = m[-1, :-1] / m[-1, -1]
        _, axes = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))
        out[int(size)] = np.ascontiguousarray(axes[:, ::-1][:, :AXES])
    return out


def grid_blocks(classes: DataFrame, radius: float, block: int = BLOCK) -> DataFrame:
    """Blocks of the vectors of one label and length in grid order, with their boxes.

    A range partitioning on label, length, cells and id sorts all vectors; the id
    comes last so that a crowded cell too can be dealt to many tasks.
    """
    spark, kind = classes.sparkSession, element(classes)
    axes = spark.sparkContext.broadcast(principal_axes(classes))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, part in frame.groupby(frame["embedding"].map(len)):
                at = units(part["embedding"]) @ axes.value[int(size)]
                at = np.pad(at, ((0, 0), (0, AXES - at.shape[1])))
                out = part.assign(size=size, at=list(at))
                for k in range(AXES):
                    out[f"c{k}"] = np.floor(at[:, k] / radius).astype(np.int64)
                yield out

    cells = [f"c{k}" for k in range(AXES)]
    placed = classes.mapInPandas(place, f"lead long, n long, label long, embedding array<{kind}>, size int, at array<double>, {', '.join(f'{c} long' for c in cells)}")
    # Written before it is sorted: the range partitioning samples its input, which would run the Python twice.
    placed = written(placed, "placed")
    order = ["label", "size", *cells, "lead"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def packed(part: pd.DataFrame, number: int) -> dict:
        at = np.stack(part["at"])
        return {
            "block": (int(part["part"].iloc[0]) << 32) + number, "label": part["label"].iloc[0], "size": part["size"].iloc[0], "low": at.min(axis=0), "high": at.max(axis=0),
            "first": part["c0"].iloc[0], "last": part["c0"].iloc[-1], "leads": part["lead"].to_numpy(), "ns": part["n"].to_numpy(), "at": at.ravel(), "vectors": np.stack(part["embedding"]).astype(PACKED[kind]).tobytes(),
        }

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = 0, None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            key = held["label"].ne(held["label"].shift()) | held["size"].ne(held["size"].shift())
            runs = [g for _, g in held.groupby(key.cumsum(), sort=False)]
            held = runs.pop()
            while len(held) >= block:
                runs.append(held.iloc[:block])
                held = held.iloc[block:]
            for run in runs:
                for start in range(0, len(run), block):
                    yield pd.DataFrame([packed(run.iloc[start : start + block], number)])
                    number += 1
        if held is not None and len(held):
            yield pd.DataFrame([packed(held, number)])

    shape = "block long, label long, size int, low array<double>, high array<double>, first long, last long, leads array<long>, ns array<long>, at array<double>, vectors binary"
    return written(dealt.mapInPandas(pack, shape), "blocks")


def near_parts(a_at: np.ndarray, b_at: np.ndarray, radius: float, same: bool) -> Iterator[tuple[slice, slice]]:
    """Parts of two grid-ordered sequences that may hold pairs within ``radius``; each pair of places at most once."""
    todo = [(0, len(a_at), 0, len(b_at))]
    while todo:
        p, q, r, s = todo.pop()
        if same and s <= p:
            continue  # the mirror image of a part that is visited
        a, b = a_at[p:q], b_at[r:s]
        gap = np.maximum(0, np.maximum(b.min(axis=0) - a.max(axis=0), a.min(axis=0) - b.max(axis=0)))
        if (gap * gap).sum() > radius * radius:
            continue
        if q - p <= LEAF and s - r <= LEAF:
            yield slice(p, q), slice(r, s)
        elif q - p >= s - r:
            m = (p + q) // 2
            todo += [(p, m, r, s), (m, q, r, s)]
        else:
            m = (r + s) // 2
            todo += [(p, q, r, m), (p, q, m, s)]


def joined(a: tuple, b: tuple, same: bool, cosine: float, radius: float) -> pd.DataFrame:
    """Links between two blocks: for each vector that has any its root in a star of its group, and how many it has."""
    (a_leads, a_ns, a_at, ax), (b_leads, b_ns, b_at, bx) = a, b
    n = len(ax)
    label, links = np.arange(n + (0 if same else len(bx))), np.zeros(n + (0 if same else len(bx)), np.int64)
    shift = 0 if same else n
    for i, j in near_parts(a_at, b_at, radius, same):
        close = ax[i] @ bx[j].T >= cosine
        if same:
            close &= np.arange(i.start, i.stop)[:, None] < np.arange(j.start, j.stop)[None, :]
        if close.any():
            links[i] += close @ b_ns[j]
            links[j.start + shift : j.stop + shift] += a_ns[i] @ close
            u, v = np.nonzero(close)
            label = merge_labels(label, u + i.start, v + j.start + shift)
    leads = a_leads if same else np.concatenate([a_leads, b_leads])
    own = np.flatnonzero(links)
    return pd.DataFrame({"node": leads[own], "root": leads[label[own]], "links": links[own]})


def links(classes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Rows (node, root, links) of all pairs of blocks; the counts of a node add up over its rows."""
    radius, kind = math.sqrt(2 - 2 * cosine) * (1 + 1e-9) + 1e-12, element(classes)
    blocks = grid_blocks(classes, radius, block)
    # Two blocks meet in the first cell of the leading axis that one covers and the other is within one of.
    side = lambda p: blocks.select("label", "size", *[F.col(c).alias(f"{p}_{c}") for c in ("block", "low", "high", "first", "last")])
    left = side("a").withColumn("cell", F.explode(F.sequence(F.col("a_first") - 1, F.col("a_last") + 1)))
    right = side("b").withColumn("cell", F.explode(F.sequence("b_first", "b_last")))
    gap = F.aggregate(
        F.arrays_zip("a_low", "a_high", "b_low", "b_high"), F.lit(0.0),
        lambda acc, x: acc + F.pow(F.greatest(F.lit(0.0), x["b_low"] - x["a_high"], x["a_low"] - x["b_high"]), 2),
    )
    pairs = left.join(right, ["label", "size", "cell"]).where((F.col("a_block") <= F.col("b_block")) & (F.col("cell") == F.greatest(F.col("a_first") - 1, "b_first")) & (gap <= radius * radius))
    pairs = pairs.select("a_block", "b_block")
    load = lambda p: blocks.select(F.col("block").alias(f"{p}_block"), *[F.col(c).alias(f"{p}_{c}") for c in ("leads", "ns", "at", "vectors", "size")])
    both = pairs.join(load("a").hint("merge"), "a_block").join(load("b").hint("merge"), "b_block")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def side(row, p: str) -> tuple:
            size = getattr(row, f"{p}_size")
            x = np.frombuffer(getattr(row, f"{p}_vectors"), PACKED[kind]).reshape(-1, size)
            return np.asarray(getattr(row, f"{p}_leads")), np.asarray(getattr(row, f"{p}_ns")), np.asarray(getattr(row, f"{p}_at")).reshape(-1, AXES), units(x)

        for frame in frames:
            for row in frame.itertuples(index=False):
                yield joined(side(row, "a"), side(row, "b"), row.a_block == row.b_block, cosine, radius)

    return both.mapInPandas(compare, "node long, root long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link when their labels are equal and not null and their cosine in
    double precision is at least ``cosine``. Vectors that are null, zero or hold
    null or non-finite components, and rows without an id, link with nothing;
    vectors of different length don't link. Equal vectors are one node that
    counts as often as it occurs, so copies are never paired. Empty tables give
    no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{element(vectors)}>").alias("embedding"))
    fit = linkable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    classes = written(rows.where(fit).groupBy("label", "embedding").agg(F.min("vec_id").alias("lead"), F.count("*").alias("n")).select("lead", "n", "label", "embedding"), "vectors")
    found = written(links(classes, cosine, block), "links")
    groups = connected_components(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.join(groups, classes["lead"] == groups["node"], "left").drop("node").join(counts, F.col("lead") == counts["node"], "left")
    placed = written(placed.select("label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "lead").alias("component_id")), "placed")
    linked = rows.where(fit).join(placed, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def embedding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every vector with its links and its group."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.a AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.a = component_id AS kept
FROM c LEFT JOIN n ON c.a = n.a
"""
