"""Near duplicates by 64-bit SimHash, compared exactly tile by tile.

Fingerprints are grouped into tiles by the population counts of their two
halves. A pair of fingerprints at most ``radius`` bits apart has half counts at
most ``radius`` apart in sum, so a tile meets only the tiles of nearby counts;
within a pair of tiles numpy compares blocks by exclusive-or and bit counts,
again skipping blocks whose quarter counts are too far apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysheet.llm.common import connected_components, row_key, rows_of, small_batches, splittable, text_or_empty, written

#: Words of a shingle, seed of its hash, bits that may differ.
WORDS, SEED, RADIUS = 3, 42, 3
#: Fingerprints in a tile at most (about), and in the blocks of a comparison.
TILE, ROWS, COLUMNS = 16384, 256, 4096


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of a whole text; null and blank texts give 0.

    ``bytes.lower`` folds A to Z alone and ``bytes.split`` splits at space and
    the controls from tab to carriage return, just as the contract says.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)) if len(found) >= words else iter([b" ".join(found)])
    ones, n = np.zeros(64, np.int64), 0
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    while len(part := np.fromiter((h for _, h in zip(range(1 << 16), hashes, strict=False)), np.uint64)):
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed longs with the same bits."""
    return pd.Series(np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts)).view(np.int64))


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Root labels of nodes after linking ``i[k]`` with ``j[k]``; roots are the smallest positions."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label = parent[label]


def quarters(prints: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, one row each."""
    return np.bitwise_count(prints.view("<u2").reshape(-1, 4)).astype(np.int16)


def boxes(counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest quarter counts of each run of ``step`` fingerprints."""
    at = np.arange(0, len(counts), step)
    return np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)


def tile_links(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Labels of the nodes of ``left`` followed by those of ``right``, linked where they are close.

    Both are uint64 arrays in the order of their quarter counts.
    """
    n, label = len(left), np.arange(len(left) + len(right))
    (llow, lhigh), (rlow, rhigh) = boxes(quarters(left), ROWS), boxes(quarters(right), COLUMNS)
    for p in range(len(llow)):
        gap = np.maximum(0, np.maximum(rlow - lhigh[p], llow[p] - rhigh)).sum(axis=1)
        rows = left[p * ROWS : (p + 1) * ROWS, None]
        for q in np.flatnonzero(gap <= radius):
            close = np.bitwise_count(rows ^ right[None, q * COLUMNS : (q + 1) * COLUMNS]) <= radius
            if close.any():
                i, j = np.nonzero(close)
                label = merge_labels(label, i + p * ROWS, j + n + q * COLUMNS)
    return label


def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of tiles to a star of links for each group of close fingerprints."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            left, right = (np.sort(np.asarray(p, np.int64).view(np.uint64)) for p in (row.prints, row.other_prints))
            left, right = (p[np.lexsort(quarters(p).T)] for p in (left, right))
            both = np.concatenate([left, right])
            label = tile_links(left, right)
            own = np.flatnonzero(both != both[label])
            yield pd.DataFrame({"a": both[label[own]].view(np.int64), "b": both[own].view(np.int64)})


def links(prints: DataFrame, tile: int = TILE, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join all close ones of the distinct fingerprints ``print`` into their groups.

    Pairs of near tiles are planned by their numbers alone; a tile's
    fingerprints, 8 bytes each, go once to each pair that it is in.
    """
    half = lambda shift: F.bit_count(F.shiftrightunsigned("print", shift).bitwiseAND(F.lit(0xFFFFFFFF)))
    keyed = prints.withColumn("key", half(32) * 64 + half(0))
    # One row for each pair of half counts: 33 x 33 at most, so it may be broadcast.
    counts = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"))
    tiles = (
        keyed.join(F.broadcast(counts), "key")
        .withColumn("chunk", F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int"))
        .groupBy("key", "chunk")
        .agg(F.collect_list("print").alias("prints"))
    )
    tiles = written(tiles, "tiles")
    # Of two tiles the one with the smaller counts is named first; a tile meets itself once.
    steps = [(u, v) for u in range(radius + 1) for v in range(-radius, radius + 1) if u + abs(v) <= radius and (u, v) >= (0, 0)]
    near = F.transform(F.array(*[F.lit(64 * u + v) for u, v in steps]), lambda s: s + F.col("key"))
    named = tiles.select("key", "chunk")
    pairs = named.withColumn("to_key", F.explode(near)).join(named.toDF("to_key", "to_chunk"), "to_key").where("to_key <> key OR to_chunk >= chunk")
    other = tiles.select(F.col("key").alias("to_key"), F.col("chunk").alias("to_chunk"), F.col("prints").alias("other_prints"))
    both = pairs.join(tiles.hint("merge"), ["key", "chunk"]).join(other.hint("merge"), ["to_key", "to_chunk"])
    return both.select("prints", "other_prints").mapInPandas(compare, "a long, b long")


def fingerprints(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Written rows ``none, id, hash, print`` of all documents; the first three tell rows apart."""
    small_batches(docs.sparkSession)
    none, number, digest = row_key(text, row_id)
    return written(docs.select(none.alias("none"), number.alias("id"), digest.alias("hash"), simhash(text_or_empty(text)).alias("print")), "prints")


def groups(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """For each fingerprint its group's first row: the smallest id, null ids last, then the smallest hash.

    Columns ``print, first`` with ``first`` a struct of none, id and hash.
    """
    nodes = written(prints.groupBy("print").agg(F.min(F.struct("none", "id", "hash")).alias("first")), "nodes")
    found = connected_components(links(nodes.select("print"), tile)).withColumnRenamed("node", "print")
    held = nodes.join(found, "print")
    least = held.groupBy("component").agg(F.min("first").alias("first"))
    grouped = written(found.join(splittable(least), "component").select("print", F.col("first").alias("least")), "groups")
    return nodes.join(grouped, "print", "left").select("print", F.coalesce("least", "first").alias("first"))


def near_duplicates(docs: DataFrame, text: str = "text", row_id: str = "doc_id", tile: int = TILE) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Texts without words have fingerprint zero and link like any other; null
    counts as empty. Rows of one fingerprint are one node, so copies are never
    paired. An id that repeats with different texts is not a link between them.
    A row whose id is null takes the group of its fingerprint, whose
    ``component_id`` is null only if no row of the group has an id. Empty tables
    give no rows; further columns are ignored.
    """
    prints = fingerprints(docs, text, row_id)
    placed = written(groups(prints, tile), "placed")
    number = lambda none, value: F.when(~F.col(none), F.col(value))
    return prints.join(placed, "print").select(number("none", "id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), number("first.none", "first.id").alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row of each group, columns as they were: the smallest id, null ids last, then any one text of that id."""
    return rows_of(docs, groups(fingerprints(docs, text, row_id)).select("first.*").distinct(), text, row_id)


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document with its fingerprint and group."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
