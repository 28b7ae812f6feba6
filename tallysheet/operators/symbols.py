"""QR symbols of payloads and back, versions 1 to 10, four levels of error correction, byte mode.

A symbol is an array of rows, each the modules of a row as the bits of a long,
leftmost highest; :func:`modules` gives it as booleans. What depends on version
and level alone (where each bit goes, what is fixed, how blocks interleave) is a
table of forty rows made from the rules of the public standard and joined by
broadcast. Symbols are made and read in numpy over Arrow batches, those of one
version and level together: Reed-Solomon codes are look-ups of what each codeword
adds, masks are exclusive-ors of rows, and the penalties that choose a mask count
bits of shifted rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysheet.functions.text import let

LEVELS = "LMQH"
#: Check codewords of a block and number of blocks by level, for versions 1 to 10. Fixed values of the standard.
CHECKS = {
    "L": (7, 10, 15, 20, 26, 18, 20, 24, 30, 18),
    "M": (10, 16, 26, 18, 24, 16, 18, 22, 22, 26),
    "Q": (13, 22, 18, 26, 18, 24, 18, 22, 20, 24),
    "H": (17, 28, 22, 16, 22, 28, 26, 26, 24, 28),
}
BLOCKS = {"L": (1, 1, 1, 1, 1, 2, 2, 2, 2, 4), "M": (1, 1, 1, 2, 2, 4, 4, 4, 5, 5), "Q": (1, 1, 2, 2, 4, 4, 6, 6, 8, 8), "H": (1, 1, 2, 4, 4, 4, 5, 6, 8, 8)}
#: Two bits that name a level, generators of the format and version codes, the format's mask, the field's polynomial. Fixed values of the standard.
LEVEL_BITS = {"L": 1, "M": 0, "Q": 3, "H": 2}
FORMAT_CODE, FORMAT_MASK, VERSION_CODE, FIELD = 0x537, 0x5412, 0x1F25, 0x11D
VERSIONS = range(1, 11)
#: Which modules a mask turns, by row and column.
MASKS: tuple[Callable[[int, int], bool], ...] = (
    lambda r, c: (r + c) % 2 == 0, lambda r, c: r % 2 == 0, lambda r, c: c % 3 == 0, lambda r, c: (r + c) % 3 == 0,
    lambda r, c: (r // 2 + c // 3) % 2 == 0, lambda r, c: r * c % 2 + r * c % 3 == 0, lambda r, c: (r * c % 2 + r * c % 3) % 2 == 0, lambda r, c: ((r + c) % 2 + r * c % 3) % 2 == 0,
)


# --- What versions and levels fix: small tables, made from rules on the driver ---


@cache
def field() -> tuple[list[int], list[int]]:
    """Powers of the field's generator, twice around, and logarithms; the logarithm of 0 is never used."""
    powers, x = [], 1
    for _ in range(255):
        powers.append(x)
        x = (x << 1) ^ (FIELD if x & 128 else 0)
    logs = [0] * 256
    for k, p in enumerate(powers):
        logs[p] = k
    return powers * 2, logs


def generator(checks: int) -> list[int]:
    """Coefficients below the leading one of the polynomial whose roots are the first powers, highest first."""
    powers, logs = field()
    times = lambda a, b: powers[logs[a] + logs[b]] if a and b else 0
    poly = [1]
    for k in range(checks):
        poly = [a ^ times(b, powers[k]) for a, b in zip([*poly, 0], [0, *poly], strict=True)]
    return poly[1:]


def coded(value: int, bits: int, code: int) -> int:
    """A value followed by its remainder by a binary code."""
    width = code.bit_length() - 1
    rest = value << width
    for k in range(bits - 1, -1, -1):
        if rest >> (k + width) & 1:
            rest ^= code << k
    return value << width | rest


def format_word(level: str, mask: int) -> int:
    return coded(LEVEL_BITS[level] << 3 | mask, 5, FORMAT_CODE) ^ FORMAT_MASK


def size_of(version: int) -> int:
    return 17 + 4 * version


def format_places(size: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Row and column of each bit of the two copies of the format, lowest bit first."""
    first = [(k, 8) for k in range(6)] + [(7, 8), (8, 8), (8, 7)] + [(8, 14 - k) for k in range(9, 15)]
    return first, [(8, size - 1 - k) for k in range(8)] + [(size - 15 + k, 8) for k in range(8, 15)]


def version_places(size: int) -> list[tuple[int, int, int]]:
    """Bit, row and column of both copies of the version."""
    return [(k, *p) for k in range(18) for p in ((k // 3, size - 11 + k % 3), (size - 11 + k % 3, k // 3))]


def centres(version: int) -> list[int]:
    """Rows and columns of the alignment patterns."""
    if version == 1:
        return []
    n, last = version // 7 + 2, size_of(version) - 7
    gap = -(-(last - 6) // (2 * (n - 1))) * 2  # even gaps, the first one takes what is left
    return [6] + [last - gap * k for k in range(n - 2, -1, -1)]


@cache
def drawn(version: int) -> dict[tuple[int, int], bool]:
    """Modules that carry no data, and whether they are dark; format modules count as light."""
    size, out = size_of(version), {}
    for r0, c0 in ((0, 0), (0, size - 7), (size - 7, 0)):
        for r in range(max(0, r0 - 1), min(size, r0 + 8)):
            for c in range(max(0, c0 - 1), min(size, c0 + 8)):
                ring = max(abs(r - r0 - 3), abs(c - c0 - 3))
                out[r, c] = ring in (0, 1, 3)
    for k in range(8, size - 8):
        out[6, k] = out[k, 6] = k % 2 == 0
    at = centres(version)
    for r0 in at:
        for c0 in at:
            if (r0, c0) not in {(6, 6), (6, size - 7), (size - 7, 6)}:
                for r in range(r0 - 2, r0 + 3):
                    for c in range(c0 - 2, c0 + 3):
                        out[r, c] = max(abs(r - r0), abs(c - c0)) != 1
    for copy in format_places(size):
        out.update(dict.fromkeys(copy, False))
    out[size - 8, 8] = True
    if version >= 7:
        word = coded(version, 6, VERSION_CODE)
        out.update({(r, c): bool(word >> k & 1) for k, r, c in version_places(size)})
    return out


def data_places(version: int) -> list[tuple[int, int]]:
    """Modules of the data bits in order: pairs of columns from the right, up and down by turns, the timing column left out."""
    size, fixed, out = size_of(version), drawn(version), []
    right = [c for c in range(size - 1, 0, -2) if c > 6] + [5, 3, 1]
    for turn, c in enumerate(right):
        for r in range(size - 1, -1, -1) if turn % 2 == 0 else range(size):
            out += [(r, x) for x in (c, c - 1) if (r, x) not in fixed]
    return out


def as_rows(size: int, dark: Callable[[int, int], bool]) -> list[int]:
    return [sum(1 << (size - 1 - c) for c in range(size) if dark(r, c)) for r in range(size)]


def block_places(version: int, level: str) -> list[list[int]]:
    """For each block the places of its codewords, data then checks, in the sequence of the symbol, which takes one of each block by turns."""
    total, checks, n = len(data_places(version)) // 8, CHECKS[level][version - 1], BLOCKS[level][version - 1]
    short, longer = divmod(total - checks * n, n)
    sizes = [short + (k >= n - longer) for k in range(n)]
    blocks: list[list[int]] = [[] for _ in sizes]
    at = 0
    for turn in range(max(sizes)):
        for k, s in enumerate(sizes):
            if turn < s:
                blocks[k].append(at)
                at += 1
    for _ in range(checks):
        for b in blocks:
            b.append(at)
            at += 1
    return blocks


@cache
def table_rows() -> list[tuple]:
    out = []
    for v in VERSIONS:
        size, places, fixed = size_of(v), data_places(v), drawn(v)
        order = {p: k for k, p in enumerate(places)}
        bits = [[order.get((r, c), -1) for c in range(size)] for r in range(size)]
        spots = [r * 64 + size - 1 - c for r, c in places]
        masks = [as_rows(size, lambda r, c, m=m: (r, c) not in fixed and m(r, c)) for m in MASKS]
        for level in LEVELS:
            blocks = block_places(v, level)
            checks, codewords = CHECKS[level][v - 1], len(places) // 8
            words = [format_word(level, m) for m in range(8)]
            shown = [{p: bool(w >> k & 1) for copy in format_places(size) for k, p in enumerate(copy)} for w in words]
            still = [as_rows(size, lambda r, c, s=s: s.get((r, c), fixed.get((r, c), False))) for s in shown]
            capacity = codewords - checks * len(blocks)
            out.append((v, level, size, capacity, capacity - (2 if v < 10 else 3), checks, generator(checks), blocks, bits, spots, masks, still))
    return out


TABLE = (
    "version int, level string, size int, capacity int, most int, checks int, generator array<int>, blocks array<array<int>>, bits array<array<int>>, spots array<int>,"
    " masks array<array<bigint>>, still array<array<bigint>>"
)


def symbol_table(spark: SparkSession) -> DataFrame:
    """One row for each of the ten versions and four levels: forty, so it may be broadcast.

    ``most`` payload bytes fit. ``bits`` has the data bit of each module, -1 where
    there is none; ``spots`` the module of each data bit as row times 64 plus
    shift; ``still`` the fixed modules and the format by mask.
    """
    return spark.createDataFrame(table_rows(), TABLE)


# --- Arithmetic of the field, as Columns ------------------------------------------


class Field:
    """Arithmetic of the field over the columns :func:`field_columns`."""

    powers = property(lambda self: F.col("powers"))
    logs = property(lambda self: F.col("logs"))

    def times(self, a: Column, b: Column) -> Column:
        return F.when((a == 0) | (b == 0), F.lit(0)).otherwise(F.get(self.powers, F.get(self.logs, a) + F.get(self.logs, b)))


def field_columns() -> dict[str, Column]:
    powers, logs = field()
    return {"powers": F.lit(powers), "logs": F.lit(logs)}


OURS = Field()


def indices(n: Column) -> Column:
    """``0 … n - 1`` for ``n`` of at least 1."""
    return F.sequence(F.lit(0), n - 1)


def check_codewords(data: Column, gen: Column, gf: Field = OURS) -> Column:
    """The remainder of a block by its generator, by a fold over its codewords."""

    def step(rest: Column, byte: Column) -> Column:
        return let(F.get(rest, 0).bitwiseXOR(byte), lambda lead: F.transform(gen, lambda g, k: F.coalesce(F.get(rest, k + 1), F.lit(0)).bitwiseXOR(gf.times(g, lead))))

    return F.aggregate(data, F.transform(gen, lambda _: F.lit(0)), step)


# --- Payload to symbol ------------------------------------------------------------

#: Symbols made at a time, for their eight masked forms to stay in a processor's cache, and read at a time.
MADE_AT_ONCE, READ_AT_ONCE = 128, 1024


@cache
def times_table() -> np.ndarray:
    """Products of all pairs of the field's elements."""
    powers, logs = (np.array(x) for x in field())
    out = powers[logs[:, None] + logs[None, :]]
    out[0, :] = out[:, 0] = 0
    return out.astype(np.uint8)


class Layout(NamedTuple):
    """What a version and level fix, as arrays; ``places`` has the place of each data bit among the 64 bits of each row, highest first."""

    version: int
    level: str
    size: int
    capacity: int
    checks: int
    blocks: list[np.ndarray]
    places: np.ndarray
    masks: np.ndarray
    still: np.ndarray


@cache
def layouts() -> dict[int, Layout]:
    """Layouts by four times the version and the place of the level in :data:`LEVELS`."""
    out = {}
    for v, level, size, capacity, _, checks, _, blocks, _, spots, masks, still in table_rows():
        bits = np.array(spots[: len(spots) // 8 * 8])
        out[4 * v + LEVELS.index(level)] = Layout(v, level, size, capacity, checks, [np.array(b) for b in blocks], bits // 64 * 64 + 63 - bits % 64, np.array(masks, np.uint64), np.array(still, np.uint64))
    return out


@cache
def check_table(length: int, checks: int) -> np.ndarray:
    """The check codewords that each value at each place of a block's data adds."""
    gen, rest, out = np.array(generator(checks)), np.array(generator(checks)), []
    for _ in range(length):
        out.append(times_table()[:, rest])
        rest = np.append(rest[1:], 0) ^ times_table()[rest[0], gen]
    return np.array(out[::-1])


def power_table(exponents: np.ndarray) -> np.ndarray:
    """For each row of exponents: each element times the generator to these powers."""
    return np.array([times_table()[:, row] for row in np.array(field()[0])[exponents % 255]])


@cache
def syndrome_table(length: int, checks: int) -> np.ndarray:
    """What each value at each place of a block adds to its values at the first powers."""
    return power_table(np.outer(np.arange(length)[::-1], np.arange(checks)))


@cache
def value_table(length: int, terms: int) -> np.ndarray:
    """What each coefficient, lowest first, adds to a polynomial's values at the powers -i, where i counts a block's codewords from the last."""
    return power_table(np.outer(np.arange(terms), 255 - np.arange(length)[::-1]))


def folded(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum in the field of what the table has for the value in each column."""
    out = table[0][values[:, 0]]
    for k in range(1, values.shape[1]):
        out ^= table[k].take(values[:, k], axis=0)
    return out


def data_codewords(data: np.ndarray, lengths: np.ndarray, at: Layout) -> np.ndarray:
    """Byte mode, the count, the bytes, a terminator and pads: everything half a byte later than it stands. ``data`` is 0 beyond the lengths."""
    head = 1 if at.version < 10 else 2
    rows = np.zeros((len(data), at.capacity + 1), np.uint8)
    rows[:, head - 1] = lengths & 255
    if head == 2:
        rows[:, 0] = lengths >> 8
    rows[:, head : head + data.shape[1]] = data
    out = rows[:, :-1] >> 4
    out[:, 0] |= 64
    out[:, 1:] |= rows[:, :-2] << 4
    beyond = np.arange(at.capacity) - (lengths + head + 1)[:, None]
    return np.where(beyond < 0, out, np.where(beyond % 2 == 0, 236, 17)).astype(np.uint8)


def interleaved(data: np.ndarray, at: Layout) -> np.ndarray:
    """Codewords of all blocks with their checks, in the order of the symbol. Blocks take the data one after the other."""
    out, start = np.empty((len(data), sum(map(len, at.blocks))), np.uint8), 0
    for places in at.blocks:
        n = len(places) - at.checks
        own = data[:, start : start + n]
        out[:, places[:n]], out[:, places[n:]] = own, folded(check_table(n, at.checks), own)
        start += n
    return out


def placed(codewords: np.ndarray, at: Layout) -> np.ndarray:
    """The rows of data modules; modules past the last codeword are light."""
    bits = np.zeros((len(codewords), at.size * 64), np.uint8)
    bits[:, at.places] = np.unpackbits(codewords, axis=1)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def penalty(x: np.ndarray, size: int) -> np.ndarray:
    """How easily symbols (rows along the last axis) are misread: runs, squares, patterns like a finder's, and more dark or light than half.

    Each count is of the bits of rows combined with themselves shifted, or with
    the rows below.
    """
    full = np.uint64((1 << size) - 1)
    count = lambda bits: np.einsum("...r->...", np.bitwise_count(bits), dtype=np.int64)
    # Pairs alike in a row, and in a row and the one below; windows of four such pairs are runs of five.
    flat, tall = ~(x ^ x >> 1) & full >> 1, ~(x[..., :-1] ^ x[..., 1:]) & full
    two = flat & flat >> 1
    across = two & two >> 2
    two = tall[..., :-1] & tall[..., 1:]
    down = two[..., :-2] & two[..., 2:]
    # Three for a run of five, one for each module more: windows of five, and two for each first one.
    runs = count(across) + 2 * count(across & ~(across << 1)) + count(down) + 2 * count(down[..., 1:] & ~down[..., :-1]) + 2 * count(down[..., :1])
    squares = count(flat[..., :-1] & flat[..., 1:] & tall)
    # The dark, light, dark, dark, dark, light, dark of a finder beside four light modules, down columns and along rows.
    row = lambda k: x[..., k : k + size - 6]
    core = row(0) & row(2) & row(3) & row(4) & row(6) & ~(row(1) | row(5))
    two = x[..., :-1] | x[..., 1:]
    light = ~(two[..., :-2] | two[..., 2:])
    finders = count(core[..., : size - 10] & light[..., 7:] & full) + count(core[..., 4:] & light[..., : size - 10] & full)
    own = x >> 6 & x >> 4 & x >> 3 & x >> 2 & x & ~(x >> 5 | x >> 1) & full >> 6
    two = x | x >> 1
    four = ~(two | two >> 2)
    # Bit j of ``own`` is a pattern ending at bit j; the four after it end at j - 4, those before it at j + 7.
    finders += count(own & (four & full) << 4) + count(own & four >> 7 & full >> 10)
    uneven = np.abs(count(x) * 20 - size * size * 10) // (size * size) * 10
    return runs + 3 * squares + 40 * finders + uneven


def masked(data: np.ndarray, at: Layout) -> tuple[np.ndarray, np.ndarray]:
    """The mask of least penalty, the first of equals, and the symbol with it."""
    forms = data[:, None] ^ at.masks | at.still
    best = penalty(forms, at.size).argmin(axis=1)
    return best, forms[np.arange(len(data)), best]


def by_layout(keys: np.ndarray, at_once: int) -> Iterator[tuple[Layout, np.ndarray]]:
    """The places of each layout's key, some at a time; other keys are left out."""
    for key, at in layouts().items():
        own = np.flatnonzero(keys == key)
        for k in range(0, len(own), at_once):
            yield at, own[k : k + at_once]


def octets(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array, one after the other, and where each value starts and the last ends."""
    data = data.cast(pa.large_binary())
    _, offsets, held = data.buffers()
    starts = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    return np.frombuffer(held or b"", np.uint8), starts


def listed(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a list array, and where each list starts; a null list is empty."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(values), 0)).astype(np.int64)
    return np.asarray(pc.fill_null(pc.list_flatten(values), 0)), np.append(0, sizes.cumsum())


@F.arrow_udf(T.StructType([T.StructField("mask", T.IntegerType()), T.StructField("rows", T.ArrayType(T.LongType()))]))
def symbols_of(data: pa.Array, key: pa.Array) -> pa.Array:
    """Mask and rows of the symbol of each payload, null where its key names no layout."""
    keys, (held, starts) = np.asarray(pc.fill_null(key, -1)), octets(data)
    sizes = np.where(keys < 0, 0, 17 + 4 * (keys // 4))
    offsets = np.append(0, sizes.cumsum())
    masks, rows = np.zeros(len(keys), np.int32), np.zeros(offsets[-1], np.int64)
    for at, own in by_layout(keys, MADE_AT_ONCE):
        lengths = starts[own + 1] - starts[own]
        k = np.arange(lengths.max())
        inside = k < lengths[:, None]
        raw = np.where(inside, held[np.where(inside, starts[own][:, None] + k, 0)], 0) if len(k) else np.zeros((len(own), 0), np.uint8)
        masks[own], drawn_ = masked(placed(interleaved(data_codewords(raw, lengths, at), at), at), at)
        rows[offsets[own][:, None] + np.arange(at.size)] = drawn_.astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows))
    return pa.StructArray.from_arrays([pa.array(masks), lists], names=["mask", "rows"], mask=pa.array(keys < 0))


def encoded(payloads: DataFrame, text: str = "payload", level: str = "level") -> DataFrame:
    """The rows of ``payloads`` with ``version, size, mask, symbol``: the smallest version that holds the text's UTF-8 bytes at its level.

    A null text or level, an unknown level and a text beyond version 10 have a
    null symbol. Byte mode holds any text; the standard's denser modes for
    digits and capitals would decode to the same text.
    """
    length = F.octet_length(F.encode(F.col(text), "utf-8"))
    fits = [F.when((F.col(level) == lv) & (length <= most), F.lit(v)) for v, lv, _, _, most, *_ in table_rows()]
    rows = payloads.withColumn("version", F.coalesce(*fits))
    key = F.col("version") * 4 + F.instr(F.lit(LEVELS), F.col(level)) - 1
    found = rows.withColumn("s", symbols_of(F.encode(F.col(text), "utf-8"), key))
    return found.select(*payloads.columns, "version", (17 + 4 * F.col("version")).alias("size"), F.col("s.mask").alias("mask"), F.col("s.rows").alias("symbol"))


def modules(symbol: Column, size: Column) -> Column:
    """A symbol as ``array<array<boolean>>``, dark is true."""
    return F.transform(symbol, lambda row: F.transform(indices(size), lambda c: F.getbit(row, size - 1 - c) == 1))


def from_modules(matrix: Column) -> Column:
    """The rows of a matrix of booleans."""
    return F.transform(matrix, lambda row: F.aggregate(row, F.lit(0).cast("long"), lambda v, dark: v * 2 + dark.cast("int")))


# --- Symbol to payload ------------------------------------------------------------

#: Formats in the order in which the first of equally near ones counts.
FORMATS = [(level, mask) for level in sorted(LEVELS) for mask in range(8)]
NO_FORMAT = 4 * len(FORMATS)


@cache
def nearest_formats() -> np.ndarray:
    """For each word of 15 bits the valid format nearest to it, as how many bits are off times 32 and its place in :data:`FORMATS`; :data:`NO_FORMAT` beyond three."""
    known = np.array([format_word(*f) for f in FORMATS])
    off = np.bitwise_count(np.arange(1 << 15)[:, None] ^ known) * np.int64(len(FORMATS)) + np.arange(len(FORMATS))
    return np.minimum(off.min(axis=1), NO_FORMAT)


def read_format(rows: np.ndarray, size: int) -> np.ndarray:
    """Places in :data:`FORMATS` of the format nearest to either copy, -1 where both are more than three bits off."""
    words = []
    for copy in format_places(size):
        bits = [(rows[:, r] >> np.uint64(size - 1 - c) & np.uint64(1)).astype(np.int64) << k for k, (r, c) in enumerate(copy)]
        words.append(nearest_formats()[sum(bits)])
    best = np.minimum(*words)
    return np.where(best < NO_FORMAT, best % len(FORMATS), -1)


def read_codewords(rows: np.ndarray, at: Layout) -> np.ndarray:
    """Codewords of unmasked symbols in the order of their bits."""
    bits = np.unpackbits(np.ascontiguousarray(rows, ">u8").view(np.uint8), axis=1)
    return np.packbits(bits.take(at.places, axis=1), axis=1)


def syndromes(blocks: np.ndarray, checks: int) -> np.ndarray:
    """Values of blocks at the first powers; all are 0 if there is no error."""
    return folded(syndrome_table(blocks.shape[1], checks), blocks)


def locators(found: np.ndarray, checks: int) -> tuple[np.ndarray, np.ndarray]:
    """The shortest recurrences of syndromes: polynomials, lowest first, and their lengths. Lengths above half the checks are beyond repair, their polynomials cut."""
    times, most = times_table().ravel(), checks // 2
    powers, logs = (np.array(x) for x in field())
    found = np.ascontiguousarray(found.T)  # one column a block from here on
    poly = np.zeros((most + 1, found.shape[1]), np.uint16)
    last, length, last_miss = np.zeros_like(poly), np.zeros(found.shape[1], np.int64), np.ones(found.shape[1], np.uint8)
    poly[0], last[1:2] = 1, 1
    for k in range(checks):
        n = min(k, most) + 1
        miss = np.bitwise_xor.reduce(times.take((poly[:n] << 8) + found[k - n + 1 : k + 1][::-1]), axis=0)
        ratio = np.where(miss == 0, 0, powers[logs[miss] - logs[last_miss] + 255]).astype(np.uint16)
        longer = (miss != 0) & (2 * length <= k)
        kept = np.where(longer, poly, last)
        poly = poly ^ times.take((last << 8) + ratio)
        length, last_miss = np.where(longer, k + 1 - length, length), np.where(longer, miss, last_miss)
        last = np.zeros_like(kept)
        last[1:] = kept[:-1]
    return np.ascontiguousarray(poly.T, np.uint8), length


def mended(blocks: np.ndarray, checks: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks with their errors corrected, and how many codewords were wrong, -1 if too many."""
    n, out, errors = blocks.shape[1], blocks.copy(), np.zeros(len(blocks), np.int64)
    found = syndromes(blocks, checks)
    bad = np.flatnonzero(found.any(axis=1))
    if not len(bad):
        return out, errors
    found, times, most = found[bad], times_table(), checks // 2
    poly, length = locators(found, checks)
    # A codeword i places before the last is wrong where the locator is 0 at the power -i.
    values = value_table(n, most + 1)
    wrong = folded(values, poly) == 0
    # The product of syndromes and locator, and the locator's slope: their values at the wrong places give the errors.
    product = np.zeros_like(poly)
    for i in range(most + 1):
        product[:, i:] ^= times[poly[:, i : i + 1], found[:, : most + 1 - i]]
    slope = np.zeros_like(poly)
    slope[:, 0:most:2] = poly[:, 1::2]
    row, place = np.nonzero(wrong)
    top, down = folded(values, product)[row, place], folded(values, slope)[row, place]
    powers, logs = (np.array(x) for x in field())
    size = np.where((top == 0) | (down == 0), 0, powers[(logs[top] - logs[down] + 255 + n - 1 - place) % 255]).astype(np.uint8)
    fixed = blocks[bad]
    fixed[row, place] ^= size
    good = (length > 0) & (length <= most) & (wrong.sum(axis=1) == length)
    good[good] = ~syndromes(fixed[good], checks).any(axis=1) if good.any() else good[good]
    out[bad[good]], errors[bad] = fixed[good], np.where(good, length, -1)
    return out, errors


def bytes_of(data: np.ndarray, at: Layout) -> tuple[np.ndarray, np.ndarray]:
    """The payload bytes of data codewords and their number, -1 unless they are one segment of bytes."""
    # Everything stands half a byte later than it would: mode, count, bytes.
    held = (data[:, :-1] & 15) << 4 | data[:, 1:] >> 4
    head = 1 if at.version < 10 else 2
    count = held[:, 0].astype(np.int64) if head == 1 else held[:, 0].astype(np.int64) * 256 + held[:, 1]
    return held[:, head:], np.where((data[:, 0] >> 4 == 4) & (count + head + 1 <= at.capacity), count, -1)


@F.arrow_udf(T.StructType([T.StructField("data", T.BinaryType()), T.StructField("errors", T.IntegerType()), T.StructField("why", T.StringType())]))
def payloads_of(symbol: pa.Array) -> pa.Array:
    """The payload's bytes and how many codewords were wrong, or why there is none, for each symbol."""
    values, starts = listed(symbol)
    sides, rows = np.diff(starts), values.astype(np.int64).view(np.uint64)
    keys, masks = np.full(len(sides), -1), np.zeros(len(sides), np.int64)
    why = np.full(len(sides), "no symbol", object)
    for version in VERSIONS:
        size = size_of(version)
        own = np.flatnonzero(sides == size)
        if len(own):
            best = read_format(rows[starts[own][:, None] + np.arange(size)], size)
            levels = np.array([LEVELS.index(level) for level, _ in FORMATS])
            keys[own], masks[own] = np.where(best < 0, -1, 4 * version + levels[best]), best % 8
            why[own] = np.where(best < 0, "no format", None)
    lengths, errors, held = np.full(len(sides), -1), np.zeros(len(sides), np.int32), {}
    for at, own in by_layout(keys, READ_AT_ONCE):
        words = read_codewords(rows[starts[own][:, None] + np.arange(at.size)] ^ at.masks[masks[own]], at)
        tried = [mended(words[:, places], at.checks) for places in at.blocks]
        whole = np.all([e >= 0 for _, e in tried], axis=0)
        raw, n = bytes_of(np.concatenate([b[:, : b.shape[1] - at.checks] for b, _ in tried], axis=1), at)
        errors[own], lengths[own] = sum(e for _, e in tried), np.where(whole, n, -1)
        why[own] = np.where(~whole, "too many errors", np.where(n < 0, "no byte mode", None))
        held.update({int(i): r for i, r in zip(own, raw, strict=True)})
    data = [held[i][:n].tobytes() if n >= 0 else None for i, n in enumerate(lengths)]
    return pa.StructArray.from_arrays([pa.array(data, pa.binary()), pa.array(errors, mask=lengths < 0), pa.array(why, pa.string())], names=["data", "errors", "why"])


def decoded(symbols: DataFrame, symbol: str = "symbol") -> DataFrame:
    """The rows of ``symbols`` with ``decoded, errors, decode_error``: the payload and how many codewords were wrong, or why there is none.

    Errors: ``no symbol`` (null, or no size of versions 1 to 10), ``no format``,
    ``too many errors`` in a block, ``no byte mode``.
    """
    found = symbols.withColumn("read_", payloads_of(F.col(symbol)))
    return found.select(*symbols.columns, F.decode(F.col("read_.data"), "utf-8").alias("decoded"), F.col("read_.errors").alias("errors"), F.col("read_.why").alias("decode_error"))


def _turned_bits(symbol: pa.Array, places: pa.Array) -> pa.Array:
    """Symbols with the named bits turned; places outside them count for nothing."""
    values, starts = listed(symbol)
    out, (spots, of) = values.astype(np.int64).view(np.uint64), listed(places)
    own = np.repeat(np.arange(len(symbol)), np.diff(of))
    row = starts[own] + (spots >> 6)
    inside = (spots >= 0) & (row < starts[own + 1])
    np.bitwise_xor.at(out, row[inside], np.left_shift(np.uint64(1), (spots[inside] & 63).astype(np.uint64)))
    gone = pc.or_(pc.is_null(symbol), pc.is_null(places))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out.view(np.int64)), mask=gone)


turned_bits = F.arrow_udf(_turned_bits, T.ArrayType(T.LongType()))


def flipped(symbol: Column, places: Column) -> Column:
    """A symbol with modules turned, each named as row times 64 plus column from the right."""
    return turned_bits(symbol, places)
