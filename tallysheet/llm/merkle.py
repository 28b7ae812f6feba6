"""Merkle manifest of a dataset: a tree of digests for each group, one over the groups' roots, and proofs.

Leaves are range-sorted into an RDD, each of whose partitions holds consecutive
leaves. The counts of a partition's first and last group are all that the driver
sees; they give each partition the place of its first leaf within its group.
Then a partition builds every complete, aligned subtree that it holds alone.
What is left, at most seven nodes at either side of a partition and level, is
shuffled by coordinate (group, level, run), level by level up to the roots.
Proofs are handed down from the roots, node by node, to chunks of 4,096 leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from typing import NamedTuple

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.llm.common import shared_dir, written

#: Children of a node; a chunk is the leaves below a node of this level.
ARITY, CHUNK_LEVEL = 8, 4
CHUNK = ARITY**CHUNK_LEVEL
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Path(NamedTuple):
    """Way from a node to the root: for each level the node's place in its run and the others of the run, left to right."""

    steps: tuple[tuple[int, tuple[str, ...]], ...]
    subroot: str
    root: str


def digest(parts) -> str:
    """Lowercase hex SHA-256 of texts put together."""
    return sha256("".join(parts).encode()).hexdigest()


def fold(node: str, steps) -> str:
    """The root that a node and a path lead to."""
    for place, others in steps:
        node = digest((*others[:place], node, *others[place:]))
    return node


def width(leaves: int, level: int) -> int:
    """Nodes of a level of a tree of so many leaves."""
    return -(-leaves // ARITY**level)


def height(leaves: int) -> int:
    """Level of the root; a lone leaf is its own root."""
    level = 0
    while width(leaves, level) > 1:
        level += 1
    return level


def leaf(columns: dict[str, Column]) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and the value; null as a dash."""
    shown = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns.values()]
    return F.sha2(F.concat(*shown), 256)


def settled_rdd(rows: RDD) -> RDD:
    """``rows`` checkpointed in the shared folder, computed once."""
    rows.persist(StorageLevel.DISK_ONLY)
    rows.checkpoint()
    rows.count()
    rows.unpersist()
    return rows


def range_sorted(rows: DataFrame, order: list[Column]) -> RDD:
    """Rows as tuples, consecutive ones of the order in one partition; checkpointed, so that partitions stay as they are counted."""
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return settled_rdd(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).rdd.map(tuple))


class Span(NamedTuple):
    """What a partition must know of others: the place of its first leaf in its group, and how many leaves its first and last group have in all."""

    start: int
    first_total: int
    last_total: int


def spans(rows: RDD) -> list[Span]:
    """One :class:`Span` for each partition, from the counts of its first and last group: a few numbers a partition reach the driver."""

    def ends(rows: Iterator[tuple]) -> Iterator[tuple | None]:
        counts = [(group, sum(1 for _ in held)) for group, held in groupby(rows, key=lambda r: r[0])]
        yield (counts[0], counts[-1], len(counts)) if counts else None

    seen = rows.mapPartitions(ends).collect()
    starts, firsts, lasts = [0] * len(seen), [0] * len(seen), [0] * len(seen)
    open_group, count = None, 0  # the group that the last partition ended with, and its leaves so far
    for k, end in enumerate(seen):
        if end:
            (first, n_first), (last, n_last), n_groups = end
            starts[k] = count if open_group == (first,) else 0
            open_group, count = (last,), (starts[k] + n_first if n_groups == 1 else n_last)
            firsts[k], lasts[k] = starts[k] + n_first, count
    open_group = None
    for k in range(len(seen) - 1, -1, -1):
        if seen[k]:
            (first, _), (last, _), n_groups = seen[k]
            if open_group == (last,):
                lasts[k] = count
            if n_groups == 1:
                firsts[k] = lasts[k]
            open_group, count = (first,), firsts[k]
    return [Span(*s) for s in zip(starts, firsts, lasts, strict=True)]


def placed(rows: RDD, known: list[Span]) -> RDD:
    """``(group, place in the group, leaves of the group, row)`` of each row."""

    def place(k: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        span, held = known[k], list(rows)
        runs = [(group, list(own)) for group, own in groupby(held, key=lambda r: r[0])]
        for r, (group, own) in enumerate(runs):
            start = span.start if r == 0 else 0
            total = span.last_total if r == len(runs) - 1 else span.first_total if r == 0 else len(own)
            yield from ((group, start + i, total, row) for i, row in enumerate(own))

    return rows.mapPartitionsWithIndex(place)


def local_trees(rows: RDD) -> RDD:
    """``((group, level, place), (digest, leaves of the group, ragged))`` from subtrees that a partition holds whole.

    A run of eight, or the last run of a level, whose nodes all lie in the
    partition becomes their parent at once. Nodes of other runs come out as
    ragged; of the rest those of the level of chunks and above, and roots.
    """

    def build(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (group, total), own in groupby(rows, key=lambda r: (r[0], r[2])):
            own = [(place, row[1]) for _, place, _, row in own]
            at, nodes, level = own[0][0], [d for _, d in own], 0
            while nodes:
                wide, end = width(total, level), at + len(nodes)
                if wide == 1:
                    yield (group, level, 0), (nodes[0], total, False)
                    break
                low = -(-at // ARITY)
                high = -(-end // ARITY) if end == wide else end // ARITY
                for place, node in enumerate(nodes, at):
                    ragged = not low <= place // ARITY < high
                    if ragged or level >= CHUNK_LEVEL:
                        yield (group, level, place), (node, total, ragged)
                nodes = [digest(nodes[r * ARITY - at : (r + 1) * ARITY - at]) for r in range(low, high)]
                at, level = low, level + 1

    return rows.mapPartitions(build)


def upper_nodes(local: RDD, parts: int, levels: int) -> RDD:
    """All nodes that the local trees left out, with ``local`` itself: ragged nodes meet their siblings by coordinate, round after round.

    A round makes a parent of every run that is whole; the others wait for
    their missing nodes, which are parents of runs below.
    """

    def meet(item: tuple) -> Iterator[tuple]:
        (group, level, run), found = item
        found = sorted(found)  # at most ARITY nodes
        total = found[0][2]
        whole = len(found) == min(ARITY, width(total, level) - run * ARITY)
        if whole:
            wide = width(total, level + 1)
            yield (group, level + 1, run), (digest(node for _, node, _ in found), total, wide > 1)
        else:
            yield from (((group, level, place), (node, total, True)) for place, node, _ in found)

    nodes, open_ = local, local.filter(lambda x: x[1][2])
    for _ in range(levels):
        keyed = open_.map(lambda x: ((x[0][0], x[0][1], x[0][2] // ARITY), (x[0][2], x[1][0], x[1][1])))
        met = keyed.groupByKey(parts).flatMap(meet)
        nodes, open_ = nodes.union(met), met.filter(lambda x: x[1][2])
    # A node that waited came out of several rounds.
    return nodes.coalesce(parts)


def chunk_paths(nodes: RDD, tops: RDD, parts: int, levels: int) -> RDD:
    """``((group, chunk), Path)``: the way from each chunk's node to the root, handed down from the groups' roots.

    ``tops`` has ``(group, (Path from the group's root on, leaves))``. A tree
    lower than a chunk is one chunk.
    """
    held = tops.map(lambda x: ((x[0], height(x[1][1]), 0), x[1][0]))
    done = held.filter(lambda x: x[0][1] <= CHUNK_LEVEL)

    def children(item: tuple) -> Iterator[tuple]:
        (group, level, _), (runs, paths) = item
        for path in paths:
            run = sorted({node for nodes in runs for node in nodes})
            others = [d for _, d in run]
            for k, (place, _) in enumerate(run):
                yield (group, level - 1, place), path._replace(steps=((k, (*others[:k], *others[k + 1 :])), *path.steps))

    above = None
    for level in range(levels, CHUNK_LEVEL, -1):
        paths = held.filter(lambda x, level=level: x[0][1] == level)
        paths = paths if above is None else paths.union(above)
        below = nodes.filter(lambda x, level=level: x[0][1] == level - 1).map(lambda x: ((x[0][0], x[0][1] + 1, x[0][2] // ARITY), (x[0][2], x[1][0])))
        # One parent and its children meet under a coordinate.
        above = below.groupByKey(parts).mapValues(list).cogroup(paths, parts).flatMap(children)
    if above is not None:
        done = done.union(above)
    return done.map(lambda x: ((x[0][0], x[0][2]), x[1]))


class Forest(NamedTuple):
    rows: RDD
    nodes: RDD
    tops: RDD
    levels: int


def grow(rows: DataFrame, order: list[Column], parts: int) -> Forest:
    """Trees over the rows ``(group, digest, …)`` of each group, in the given order, which begins with the group."""
    held = range_sorted(rows, order)
    known = spans(held)
    leaves = placed(held, known)
    local = settled_rdd(local_trees(leaves))
    levels = max((height(max(s.first_total, s.last_total)) for s in known), default=0)
    nodes = settled_rdd(upper_nodes(local, parts, levels))
    tops = nodes.filter(lambda x: x[0][1] == height(x[1][1])).map(lambda x: (x[0][0], (x[1][0], x[1][1])))
    return Forest(leaves, nodes, tops, levels)


def members(forest: Forest, tops: RDD, parts: int) -> RDD:
    """``(row, Path of its leaf)`` of each row; ``tops`` has the way on from each group's root."""
    rows = forest.rows.map(lambda x: ((x[0], x[1] // CHUNK), (x[1], x[3], x[2])))
    paths = chunk_paths(forest.nodes, tops, parts, forest.levels)

    def walk(item: tuple) -> Iterator[tuple]:
        _, (own, found) = item
        own, path = sorted(own, key=lambda x: x[0]), next(iter(found))
        rows, below, level, total = [row for _, row, _ in own], [], [row[1] for _, row, _ in own], own[0][2]
        # The last chunk of a taller tree may be one node wide and still goes up level by level.
        for _ in range(min(CHUNK_LEVEL, height(total))):
            below.append(level)
            level = [digest(level[r : r + ARITY]) for r in range(0, len(level), ARITY)]
        for k, row in enumerate(rows):
            steps, place = [], k
            for nodes in below:
                run = nodes[place // ARITY * ARITY : place // ARITY * ARITY + ARITY]
                steps.append((place % ARITY, (*run[: place % ARITY], *run[place % ARITY + 1 :])))
                place //= ARITY
            yield row, path._replace(steps=(*steps, *path.steps))

    return rows.cogroup(paths, parts).flatMap(walk)  # at most CHUNK leaves and one path a group


def manifest(docs: DataFrame, group: str = "lang", row_id: str = "doc_id", fields: tuple[str, ...] = FIELDS) -> RDD:
    """``((group, leaf, id, tampered leaf), Path)`` of each row of ``docs``.

    Leaves of a group stand in the order of the id, null ids last, rows of one
    id in the order of their leaves, so repeated rows are leaves of their own and
    reruns agree. Null is a group, the first. A null field is a dash, an empty
    text ``0:``. The tampered leaf is that of the text in lower case (A to Z)
    where 3 divides the CRC-32 of the id, else the leaf; a null id or text stays.
    An empty table has no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {c: F.col(f"`{c}`").cast("string") for c in fields}
    number = F.col(f"`{row_id}`").cast("long")
    hit = F.coalesce(F.crc32(number.cast("string")) % 3 == 0, F.lit(False))
    tampered = values | ({"text": F.translate(values["text"], UPPER, LOWER)} if "text" in values else {})
    rows = docs.select(F.col(f"`{group}`").cast("string").alias("grp"), leaf(values).alias("leaf"), number.alias("id"), F.when(hit, leaf(tampered)).alias("tampered"))
    rows = written(rows, "leaves")
    trees = grow(rows, [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_last(), F.col("leaf").asc()], parts)
    # The groups' roots are the leaves of one more tree.
    subroots = spark.createDataFrame(trees.tops.map(lambda x: (0, x[1][0], x[0], x[1][1])), "all int, leaf string, grp string, n long")
    over = grow(subroots, [F.col("all"), F.col("grp").asc_nulls_first()], parts)
    root = over.tops.map(lambda x: (x[0], (Path((), "", x[1][0]), x[1][1])))
    tops = members(over, root, parts).map(lambda x: (x[0][2], (x[1]._replace(subroot=x[0][1]), x[0][3])))
    return members(trees, tops, parts)


def proofs(docs: DataFrame, group: str = "lang", row_id: str = "doc_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The whole proof of each row: ``doc_id, leaf, subroot, root, proof`` with ``proof`` an array of (place, others), leaf level first."""
    found = manifest(docs, group, row_id, fields).map(lambda x: (x[0][2], x[0][1], x[1].subroot, x[1].root, [(k, list(others)) for k, others in x[1].steps]))
    return docs.sparkSession.createDataFrame(found, "doc_id long, leaf string, subroot string, root string, proof array<struct<place: int, others: array<string>>>", verifySchema=False)


def audited(docs: DataFrame, group: str = "lang", row_id: str = "doc_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Digests of the proofs and a check of each: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``folded_root`` is what the tampered leaf (see :func:`manifest`) and the proof
    lead to, so ``verified`` tells the rows whose text was changed.
    """

    def audit(item: tuple) -> tuple:
        (_, own, number, tampered), path = item
        folded = fold(tampered or own, path.steps)
        return number, own, path.subroot, path.root, digest(d for _, others in path.steps for d in others), folded, folded == path.root

    columns = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return docs.sparkSession.createDataFrame(manifest(docs, group, row_id, fields).map(audit), columns, verifySchema=False)


def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every document with its leaf, roots and checked proof."""
    return audited(spark.read.parquet(f"{sf_dir}/documents.parquet"))


MERKLE_SQL = r"""
WITH RECURSIVE
crc_table AS (  -- CRC-32 of a byte, by eight steps of the reversed polynomial
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(n))),
d AS (
  SELECT *, doc_id IS NOT NULL AND xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
      lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295) % 3 = 0 AS hit
  FROM documents, crc_table),
f AS (
  SELECT doc_id, lang, hit, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d),
leaf AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS tampered
  FROM f),
nodes AS (
  SELECT lang, 0 AS lvl, idx, n, leaf AS h FROM leaf
  UNION ALL
  SELECT lang, lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, idx // 8, n),
tops AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
over AS (
  SELECT 0 AS lvl, idx, n, subroot AS h FROM tops
  UNION ALL
  SELECT lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM over WHERE n > 1 GROUP BY lvl, idx // 8, n),
runs AS (
  SELECT 'tree' || coalesce(lang, '') || (lang IS NULL) AS tree, lvl, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT 'over', lvl, idx // 8, list(h ORDER BY idx) FROM over WHERE n > 1 GROUP BY ALL),
inner_walk AS (
  SELECT doc_id, leaf, lang, 'tree' || coalesce(lang, '') || (lang IS NULL) AS tree, 0 AS lvl, idx, n, tampered AS h, '' AS proof FROM leaf
  UNION ALL
  SELECT doc_id, leaf, lang, w.tree, w.lvl + 1, idx // 8, (n + 7) // 8,
    sha256(array_to_string(hs[1:idx % 8], '') || h || array_to_string(hs[idx % 8 + 2:], '')), proof || array_to_string(hs[1:idx % 8], '') || array_to_string(hs[idx % 8 + 2:], '')
  FROM inner_walk w JOIN runs r ON r.tree = w.tree AND r.lvl = w.lvl AND r.run = idx // 8 WHERE n > 1),
outer_walk AS (
  SELECT doc_id, leaf, subroot, 0 AS lvl, t.idx, t.n, h, proof FROM inner_walk w JOIN tops t ON w.lang IS NOT DISTINCT FROM t.lang WHERE w.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, w.lvl + 1, idx // 8, (n + 7) // 8,
    sha256(array_to_string(hs[1:idx % 8], '') || h || array_to_string(hs[idx % 8 + 2:], '')), proof || array_to_string(hs[1:idx % 8], '') || array_to_string(hs[idx % 8 + 2:], '')
  FROM outer_walk w JOIN runs r ON r.tree = 'over' AND r.lvl = w.lvl AND r.run = idx // 8 WHERE n > 1)
SELECT doc_id, leaf, subroot, o.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = o.h AS verified
FROM outer_walk w, over o WHERE w.n = 1 AND o.n = 1
"""
