"""Repeated byte strings across documents by suffix arrays, built block by block with a difference cover.

A suffix of a document matters for its first ``MATCH`` bytes only. To bring equal
ones together, every suffix is filed under one 16-byte gram among those bytes,
the one of the least hash; consecutive suffixes with the same gram travel as one
piece of text. Pieces are shuffled by the gram's hash into buckets. The pieces of
a bucket are one text, whose suffix array a task sorts: first the suffixes at the
sample positions of a difference cover get ranks; then one block of suffixes
after the other, a range of leading bytes each, is sorted by its first ``COVER``
bytes, and ties are resolved by the ranks of two sample positions equally far
ahead. Runs of suffixes that share ``MATCH`` bytes tell which bytes are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysheet.llm.common import row_key, small_batches, text_or_empty, written

#: Bytes of a repeat at least, and of the gram that files it; places of a gram within a repeat.
MATCH, GRAM = 50, 16
PLACES = MATCH - GRAM + 1
#: Period of the difference cover and its residues: every difference modulo 13 is one between two of them.
COVER, RESIDUES = 13, (0, 1, 3, 9)
#: Bytes of text that a task turns into pieces at a time, starts hashed at once, bytes of pieces in a bucket (about), of a text that is sorted at once, and suffixes in a block.
BLOCK, CHUNK, BUCKET, SORTED, SUFFIXES = 8 << 20, 1 << 18, 32 << 20, 4 << 20, 1 << 17
#: The place of a null id: after all others.
LAST = (1 << 63) - 1
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
TAIL = b"\0" * 128


def words(data: bytes) -> np.ndarray:
    """The eight bytes from each place on as a number of the same order; the places of ``TAIL``, which ``data`` ends with, but for the last seven, count too."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        own = len(out[k::8])
        out[k::8] = np.frombuffer(data, ">u8", own, k)
    return out


@cache
def shifts() -> np.ndarray:
    """For two residues, how far ahead both meet the difference cover."""
    return np.array([[next(k for k in range(COVER) if (i + k) % COVER in RESIDUES and (j + k) % COVER in RESIDUES) for j in range(COVER)] for i in range(COVER)])


def expanded(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[k], starts[k] + 1, …`` for ``lengths[k]`` numbers, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def grams(word: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """For the starts ``first`` to ``last`` the place of the gram that files them and its hash.

    The gram has the least hash of the ``PLACES`` grams within the next
    ``MATCH`` bytes, the leftmost one of equals.
    """
    n = last - first + PLACES - 1
    with np.errstate(over="ignore"):
        hashed = word[first : first + n] * MIX[0] + word[first + 8 : first + 8 + n] * MIX[1]
        hashed ^= hashed >> np.uint64(29)
        hashed *= MIX[2]
    low = np.uint64((1 << 20) - 1)
    least = (hashed & ~low) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= PLACES:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < PLACES:
        least = np.minimum(least[: last - first], least[PLACES - size : PLACES - size + last - first])
    place = (least & low).astype(np.int64)
    return place + first, hashed[place]


def content_hash(word: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of ``length`` bytes (8 or more) from each start on."""
    with np.errstate(over="ignore"):
        out = word[start + length - 8] * MIX[1] + length.astype(np.uint64)
        for k in range(0, int(length.max(initial=0)) - 7, 8):
            out = np.where(k + 8 <= length, (out ^ (out >> np.uint64(31))) * MIX[2] + word[start + np.minimum(k, length - 8)] * MIX[0], out)
    return out


def same_content(word: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``length`` bytes (8 or more) from two starts on are equal."""
    out = word[a + length - 8] == word[b + length - 8]
    for k in range(0, int(length.max(initial=0)) - 7, 8):
        at = np.minimum(k, length - 8)
        out &= word[a + at] == word[b + at]
    return out


def packed(columns: list[np.ndarray]) -> bytes:
    sizes = np.array([c.nbytes for c in columns], "<u8")
    return zstandard.ZstdCompressor(level=3).compress(b"".join([sizes.tobytes(), *[c.tobytes() for c in columns]]))


#: Columns of a blob: starts of a piece, place of its gram, rows that have it, their ids, tags and places, the pieces' bytes.
KINDS = ("u1", "u1", "<u4", "<i8", "<i4", "<i8", "u1")


def unpacked(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(data, "<u8", len(KINDS)).astype(np.int64)
    ends = 8 * len(KINDS) + np.cumsum(sizes)
    return [np.frombuffer(data[e - s : e], kind) for s, e, kind in zip(sizes, ends, KINDS, strict=True)]


def filed(texts: list[bytes], ids: np.ndarray, tags: np.ndarray, bases: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """The pieces of some texts, parts of documents from ``bases`` on, by bucket; a piece that occurs again in these texts is packed once, with the places where it occurs."""
    data = b"".join([*texts, TAIL])
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    begin = end - size
    valid = np.zeros(len(data), bool)
    valid[: end[-1] if len(end) else 0] = True
    valid[np.maximum(end[:, None] - np.arange(1, MATCH)[None], begin[:, None])[size > 0].ravel()] = False
    word, held = words(data), []
    for first in range(0, len(data) - len(TAIL), CHUNK):
        last = min(first + CHUNK, len(data) - len(TAIL))
        place, hashed = grams(word, first, last)
        ok = valid[first:last]
        # A piece begins where the gram changes, and after starts that don't count.
        cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])]))
        length = np.diff(np.append(cut, last - first))
        cut, length = cut[ok[cut]], length[ok[cut]]
        held.append((cut + first, length, place[cut] - cut - first, hashed[cut]))
    if not held:
        return
    start, count, gram, hashed = (np.concatenate(c) for c in zip(*held, strict=True))
    with np.errstate(over="ignore"):  # mixed anew, for the least of many hashes is small
        bucket = ((hashed * MIX[1] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    length = count + (MATCH - 1)
    content = content_hash(word, start, length)
    order = np.lexsort((content, bucket))
    start, count, gram, bucket, length, content = (c[order] for c in (start, count, gram, bucket, length, content))
    new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (content[1:] != content[:-1])])[: len(start)]
    leader = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (count == count[leader]) & (gram == gram[leader])
    same &= same_content(word, start, np.where(same, start[leader], start), length)
    if not same.all():  # hashes that met by chance: each such piece leads itself
        leader = np.where(same, leader, np.arange(len(start)))
        order = np.argsort(leader, kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        start, count, gram, bucket, length, leader = (c[order] for c in (start, count, gram, bucket, length, leader))
        new = np.concatenate([[True], leader[1:] != leader[:-1]])
    lead = np.flatnonzero(new)
    rows = np.diff(np.append(lead, len(start)))
    text = np.searchsorted(end, start, "right")
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(edge, np.append(edge[1:], len(start)), strict=True):
        # Pieces of a bucket in the order of the text, which packs better.
        la, lb = np.searchsorted(lead, [a, b])
        own = np.argsort(start[lead[la:lb]], kind="stable") + la
        places = expanded(lead[own], rows[own])
        yield int(bucket[a]), packed([
            count[lead[own]].astype("u1"), gram[lead[own]].astype("u1"), rows[own].astype("<u4"),
            ids[text[places]].astype("<i8"), tags[text[places]].astype("<i4"), (start[places] - begin[text[places]] + bases[text[places]]).astype("<i8"),
            raw[expanded(start[lead[own]], length[lead[own]])],
        ])


def pieces(buckets: int):
    """Rows ``id, tag, data`` to blobs of pieces, one for each bucket and ``BLOCK`` bytes of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            texts, ids, tags, bases = zip(*held, strict=True)
            found = list(filed(list(texts), np.array(ids, np.int64), np.array(tags, np.int64), np.array(bases, np.int64), buckets))
            return pa.record_batch([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for number, tag, data in zip(batch["id"].to_pylist(), batch["tag"].to_pylist(), batch["data"], strict=True):
                data = data.as_py()
                for base in range(0, max(1, len(data) - MATCH + 1), BLOCK):
                    held.append((data[base : base + BLOCK + MATCH - 1], number, tag, base))
                    size += len(held[-1][0])
                    if size >= BLOCK:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return run


def ranked(key: np.ndarray) -> np.ndarray:
    """Ranks from 0 of numbers, equal ones alike."""
    order = np.argsort(key)
    own = key[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])[: len(order)]
    return rank


def head_ranks(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of places by their next ``COVER`` bytes: by eight, then by the five after them."""
    return ranked((ranked(word[at]) << 40) | (word[at + 8] >> np.uint64(24)).astype(np.int64))


def cover_ranks(word: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the suffixes at sample positions by their first 52 bytes, by doubling from ``COVER`` bytes on; other places hold nothing.

    A sample position has one ``COVER`` bytes ahead, so pairs of ranks double what they tell.
    """
    at = np.flatnonzero(np.isin(np.arange(COVER), RESIDUES))
    at = (np.arange(0, n, COVER)[:, None] + at[None]).ravel()
    at = at[at < n]
    known = head_ranks(word, at)
    rank, reach = np.zeros(n + 8 * COVER, np.int64), COVER  # the end sorts before all, by rank 0
    while reach < MATCH:
        rank[at] = known + 1
        known = ranked((known << 32) | rank[at + reach])
        reach *= 2
    rank[at] = known + 1
    return rank


def resolved(at: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Suffixes of groups that share their first ``COVER`` bytes, in the order of suffixes; groups stay where they are.

    Three-way quicksort of all groups at once: a suffix and its group's pivot are
    compared by the ranks of the nearest places ahead that are both in the cover.
    """
    out, live, ahead = at.copy(), np.arange(len(at)), shifts()
    while True:
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(live) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(live)))
        keep = np.repeat(size > 1, size)
        live, group = live[keep], group[keep]
        if not len(live):
            return out
        size = size[size > 1]
        edge = np.cumsum(size) - size
        own, pivot = out[live], np.repeat(out[live[edge + size // 2]], size)
        step = ahead[own % COVER, pivot % COVER]
        side = np.sign(rank[own + step] - rank[pivot + step]) + 1
        key = np.repeat(np.arange(len(size)), size) * 3 + side
        order = np.argsort(key, kind="stable")
        out[live] = own[order]
        key = key[order]
        rest = key % 3 != 1  # equal to the pivot: these share MATCH bytes
        live, group = live[rest], key[rest]


def suffix_blocks(word: np.ndarray, starts: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The given suffixes of a text of ``n`` bytes in order, a block of leading bytes at a time."""
    rank = cover_ranks(word, n)
    lead = word[starts]
    if len(starts) > SUFFIXES:
        step = max(1, len(starts) // (64 * (len(starts) // SUFFIXES + 1)))
        drawn = np.sort(lead[::step])
        bounds = np.unique(drawn[:: max(1, 64)])
        block = np.searchsorted(bounds, lead, "right")
        by_block = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[by_block])) + 1
        blocks = np.split(by_block, cuts)
    else:
        blocks = [np.arange(len(starts))]
    for own in blocks:
        group = head_ranks(word, starts[own])
        order = np.argsort(group)
        yield resolved(starts[own[order]], group[order], rank)


def least_ids(data: np.ndarray, starts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each start the least of ``least`` over the starts with the same next ``MATCH`` bytes."""
    word, n = words(data.tobytes() + TAIL), len(data)
    slot = np.zeros(n, np.int64)
    slot[starts] = np.arange(len(starts))
    out = np.empty(len(starts), np.int64)
    for at in suffix_blocks(word, starts, n):
        same = same_content(word, at[1:], at[:-1], np.full(max(0, len(at) - 1), MATCH))
        edge = np.flatnonzero(np.concatenate([[True], ~same]))[: len(at)]
        own = slot[at]
        found = np.minimum.reduceat(least[own], edge) if len(at) else np.zeros(0, np.int64)
        out[own] = np.repeat(found, np.diff(np.append(edge, len(at))))
    return out


def eights(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number of the same order."""
    return raw[at[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)


def combined(raw: np.ndarray, begin: np.ndarray, length: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal pieces as one: the pieces that stand for themselves, and for every piece the number of the one that stands for it."""
    data = raw[expanded(begin, length)]
    at = np.cumsum(length) - length
    word = words(data.tobytes() + TAIL)
    content = content_hash(word, at, length)
    order = np.argsort(content, kind="stable")
    own = content[order]
    new = np.concatenate([[True], own[1:] != own[:-1]])[: len(order)]
    leader = np.empty(len(order), np.int64)
    leader[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = count == count[leader]
    same &= same_content(word, at, np.where(same, at[leader], at), length)
    leader = np.where(same, leader, np.arange(len(order)))  # hashes that met by chance
    lead = np.flatnonzero(leader == np.arange(len(order)))
    return lead, np.searchsorted(lead, leader)


def repeats(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows ``id, tag, at`` of repeated strings among the pieces of a bucket; ``at`` is the first byte times 128 plus the number of bytes."""
    count, gram, rows, ids, tags, places, raw = (np.concatenate(c) for c in zip(*map(unpacked, blobs), strict=True))
    count, gram, rows = count.astype(np.int64), gram.astype(np.int64), rows.astype(np.int64)
    length = count + (MATCH - 1)
    begin, first = np.cumsum(length) - length, np.cumsum(rows) - rows
    low, high = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
    # Only a gram that two documents have can lie in a repeat.
    key = (ranked(eights(raw, begin + gram)) << 32) | ranked(eights(raw, begin + gram + 8))
    order = np.argsort(key)
    own = key[order]
    edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    size = np.diff(np.append(edge, len(order)))
    many = np.minimum.reduceat(low[order], edge) < np.maximum.reduceat(high[order], edge)
    # Whole grams, up to SORTED bytes of pieces at a time.
    order, size = order[np.repeat(many, size)], size[many]
    if not len(size):
        return
    ends = np.cumsum(size)
    weight = np.cumsum(np.add.reduceat(length[order], ends - size))
    part = (weight - 1) // SORTED
    last = np.flatnonzero(np.append(part[1:] != part[:-1], True))
    for a, b in zip([0, *ends[last[:-1]]], ends[last], strict=True):
        own = order[a:b]
        # Equal pieces of several blobs become one, with the least id of all.
        lead, stands = combined(raw, begin[own], length[own], count[own])
        one = own[lead]
        floor = np.full(len(one), LAST)
        np.minimum.at(floor, stands, low[own])
        data = raw[expanded(begin[one], length[one])]
        starts = expanded(np.cumsum(length[one]) - length[one], count[one])
        least = least_ids(data, starts, np.repeat(floor, count[one]))
        # Every row that has a piece, with every start of the piece.
        slot = (np.cumsum(count[one]) - count[one])[stands]
        row = expanded(first[own], rows[own])
        piece = np.repeat(np.arange(len(own)), rows[own])
        owner = np.repeat(np.arange(len(row)), count[own][piece])
        place = expanded(places[row], count[own][piece])
        hit = least[expanded(slot[piece], count[own][piece])] < ids[row][owner]
        owner, place = owner[hit], place[hit]
        if len(owner):
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)]))
            run = np.diff(np.append(new, len(owner)))
            yield ids[row][owner[new]], tags[row][owner[new]], place[new] * 128 + run + (MATCH - 1)


def sorted_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blobs of a bucket to repeats."""
    blobs = [blob for batch in batches for blob in batch["blob"].to_pylist()]
    if blobs:
        for ids, tags, at in repeats(blobs):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(tags, pa.int32()), pa.array(at, pa.int64())], ["id", "tag", "at"])


def row_tag(text: str = "text", row_id: str = "doc_id") -> tuple[Column, Column]:
    """What tells rows apart here: the id, null after all others, and 32 bits of the text's hash."""
    none, number, digest = row_key(text, row_id)
    return F.when(none, F.lit(LAST)).otherwise(number), F.shiftright(digest, 32).cast("int")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries run meanwhile are deleted when the query ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spans(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Rows ``id, tag, at`` of strings of ``MATCH`` bytes or more that a document of a smaller id has; see :func:`repeats`. They overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length(text_or_empty(f"`{text}`")))).first()[0] or 0
    parts = max(parts, 4 * total // BUCKET)  # pieces are about four times the texts
    number, tag = row_tag(text, row_id)
    rows = docs.select(number.alias("id"), tag.alias("tag"), text_or_empty(f"`{text}`").cast("binary").alias("data")).where(F.octet_length("data") >= MATCH)
    blobs = rows.mapInArrow(pieces(parts), "bucket int, blob binary")
    # A bucket is a partition; its blobs are dropped when its repeats are written.
    found = blobs.repartitionById(parts, F.col("bucket")).mapInArrow(sorted_bucket, "id long, tag int, at long")
    with shuffles_dropped(spark):
        return written(found, "repeats")


def merged(at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint, not touching spans (first byte, byte after the last) of packed ones."""
    if at is None or not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.sort(np.asarray(at, np.int64))
    begin, end = at >> 7, (at >> 7) + (at & 127)
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    return begin[new], reach[np.append(new[1:] - 1, len(at) - 1)]


def cut(data: bytes, at: np.ndarray | None) -> tuple[bytes, int, int]:
    """What is left of a text without its spans, how many bytes were removed, in how many runs."""
    begin, end = merged(at)
    if not len(begin):
        return data, 0, 0
    left = b"".join(data[a:b] for a, b in zip(np.append(0, end), np.append(begin, len(data)), strict=True))
    return left, len(data) - len(left), len(begin)


CUT = T.StructType().add("n_bytes", T.LongType()).add("n_removed", T.LongType()).add("n_spans", T.LongType()).add("kept_sha256", T.StringType())


@F.pandas_udf(CUT)
def cut_digest(data: pd.Series, at: pd.Series) -> pd.DataFrame:
    rows = []
    for d, a in zip(data, at, strict=True):
        left, removed, runs = cut(d, a)
        rows.append((len(d), removed, runs, hashlib.sha256(left).hexdigest()))
    return pd.DataFrame(rows, columns=CUT.names)


@F.pandas_udf(T.BinaryType())
def cut_bytes(data: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series([cut(d, a)[0] for d, a in zip(data, at, strict=True)], dtype=object)


def with_spans(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``doc_id, data, at``: the id and bytes of each row of ``docs`` and the spans that go (null if none). Texts are shuffled once."""
    number, tag = row_tag(text, row_id)
    # As many spans as a document has pieces at most, 8 bytes each.
    found = spans(docs, text, row_id).groupBy("id", "tag").agg(F.collect_list("at").alias("at"))
    rows = docs.select(F.col(f"`{row_id}`").cast("long").alias("doc_id"), number.alias("id"), tag.alias("tag"), text_or_empty(f"`{text}`").cast("binary").alias("data"))
    return rows.join(found, ["id", "tag"], "left").select("doc_id", "data", "at")


def without_repeats(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, kept`` with ``kept`` the bytes that stay (they need not be whole UTF-8); see :func:`removals`."""
    return with_spans(docs, text, row_id).select("doc_id", cut_bytes("data", "at").alias("kept"))


def removals(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Each byte goes that lies in a string of ``MATCH`` bytes which also starts in a
    document of a smaller id, strings being judged on the input. Null text is
    empty; texts under ``MATCH`` bytes keep everything; a null id is greater than
    all others; rows of one id remove nothing from each other; rows alike fare
    alike. An empty table gives no rows; further columns are ignored.
    """
    return with_spans(docs, text, row_id).select("doc_id", cut_digest("data", "at").alias("c")).select("doc_id", "c.*")


def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every document with what is left of it."""
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
