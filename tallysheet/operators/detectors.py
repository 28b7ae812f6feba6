"""Detectors of QR symbols on pages as plug-ins, and one that finds upright symbols by their corners.

A detector is a function from a grey image to what it found: places, and either
the text or the modules of a symbol. Detectors run on the executors over Arrow
batches; what the modules say is read by Column functions (``operators.symbols``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysheet.operators import symbols
from tallysheet.operators.plugins import Registry

FOUND = "image_id long, seq int, method string, region string, region_rank int, x int, y int, w int, h int, confidence double, data string, symbol array<long>, error_message string"
#: Runs of dark and light through the middle of a corner mark. Fixed values.
MARK = np.array([1, 1, 3, 1, 1])


@dataclass
class Found:
    """A symbol: its box, and its text or its modules (dark is true)."""

    x: int
    y: int
    w: int
    h: int
    text: str | None = None
    modules: np.ndarray | None = None
    confidence: float = 1.0


Detector = Callable[[np.ndarray], list[Found]]


def _marks(dark: np.ndarray, top: int, left: int) -> dict[tuple[int, int], tuple[float, float]]:
    """Where five runs along a row are as wide as those of a mark: row and column of the middle, its exact place, a module's width; ``dark`` is a part that begins at ``top`` and ``left``."""
    h, w = dark.shape
    flat = np.zeros((h, w + 2), bool)
    flat[:, 1:-1] = dark
    flat = flat.ravel()
    turns = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    if len(turns) < 6:
        return {}
    # Rows begin and end light, so every other run is dark, the first one too.
    first, after = turns[:-5:2], turns[5::2]
    unit = (after - first) / 7
    likely = np.flatnonzero(np.abs(turns[3:-2:2] - turns[2:-3:2] - 3 * unit) <= np.maximum(unit / 2, 0.5))
    first, unit = first[likely], unit[likely]
    runs = np.diff(turns[2 * likely[:, None] + np.arange(6)], axis=1)
    one_row = first // (w + 2) == (after[likely] - 1) // (w + 2)
    good = one_row & (np.abs(runs - MARK * unit[:, None]) <= np.maximum(unit / 2, 0.5)[:, None]).all(axis=1)
    row, start = np.divmod(first[good], w + 2)
    middle = start + left - 1 + unit[good] * 3.5
    return {(int(r), int(m)): (float(m), float(u)) for r, m, u in zip(row + top, middle, unit[good], strict=True)}


def _sampled(dark: np.ndarray, corner: np.ndarray, across: np.ndarray, down: np.ndarray, size: int) -> np.ndarray:
    """The modules of a symbol from the middle of a corner mark and the ways to the next column and row."""
    k = np.arange(size) - 3
    at = corner + k[None, :, None] * across + k[:, None, None] * down
    at = np.clip(np.floor(at).astype(int), 0, np.array(dark.shape)[::-1] - 1)
    return dark[at[..., 1], at[..., 0]]


def upright_symbols(image: np.ndarray, alike: float = 0.8) -> list[Found]:
    """Symbols of versions 1 to 10 whose sides are parallel to the page's, in any quarter turn.

    Corner marks lie where a row and a column both show a mark's runs; three of
    them at equal distances, one the corner of the others, make a symbol if its two
    lines of alternating modules alternate in a share of at least ``alike``.
    """
    if image.size == 0 or (least := image.min()) == (most := image.max()):
        return []
    middle = (int(least) + int(most) + 1) / 2
    dark = image < (math.ceil(middle) if np.issubdtype(image.dtype, np.integer) else middle)
    # Marks lie within the smallest box around all that is dark.
    rows = np.flatnonzero(dark.any(axis=1))
    top, bottom = int(rows[0]), int(rows[-1]) + 1
    columns = np.flatnonzero(dark[top:bottom].any(axis=0))
    left = int(columns[0])
    inner = dark[top:bottom, left : columns[-1] + 1]
    along, down = _marks(inner, top, left), _marks(inner.T, left, top)
    marks = [(along[r, c][0], down[c, r][0], (along[r, c][1] + down[c, r][1]) / 2) for r, c in along if (c, r) in down]
    out = []
    for x, y, unit in marks:
        beside = [m for m in marks if abs(m[1] - y) <= unit and abs(m[0] - x) > 7 * unit]
        below = [m for m in marks if abs(m[0] - x) <= unit and abs(m[1] - y) > 7 * unit]
        best = None
        for bx, by, _ in beside:
            for vx, vy, _ in below:
                far = abs(bx - x)
                version = round((far / unit + 7 - 17) / 4)
                size = symbols.size_of(version)
                if abs(far - abs(vy - y)) > unit or version not in symbols.VERSIONS or abs(far / unit + 7 - size) > 2 or best and best[0] <= size:
                    continue
                corner, a, b = np.array([x, y]), np.array([bx - x, by - y]) / (size - 7), np.array([vx - x, vy - y]) / (size - 7)
                across, under = (a, b) if (bx - x) * (vy - y) > 0 else (b, a)
                m = _sampled(dark, corner, across, under, size)
                lines = np.concatenate([m[6, 8:-8], m[8:-8, 6]])
                if (lines == (np.arange(len(m[6, 8:-8])) % 2 == 0).tolist() * 2).mean() < alike:
                    continue
                ends = np.array([corner + i * across + j * under for i in (-3.5, size - 3.5) for j in (-3.5, size - 3.5)])
                (x0, y0), (x1, y1) = np.rint(ends.min(axis=0)).astype(int), np.rint(ends.max(axis=0)).astype(int)
                best = size, Found(int(x0), int(y0), int(x1 - x0), int(y1 - y0), modules=m)
        if best:
            out.append(best[1])
    return out


class Detectors(Registry):
    """U4: detectors by name, with priority, the packages they need, and capabilities."""

    def sound(self, result: object) -> bool:
        return isinstance(result, list) and all(isinstance(f, Found) for f in result)

    def search(self, images: DataFrame, regions: list[tuple[str, float, float, float, float]], least: int = 50, most: int = 500, names: list[str] | None = None) -> DataFrame:
        """Each image region by region until one holds a symbol whose longer side is within bounds; in a region all detectors are asked.

        ``pixels`` are an array of greys, or a binary with one byte for each.
        Regions are names and shares of the page (x, y, width, height) in the order
        of search; boxes are relative to their region. A detector that raises gives
        an error row and the others go on.
        """
        ranked = sorted(names or self.available(), key=lambda n: self.engines[n]["priority"])
        asked = [(n, self.engines[n]["engine"]) for n in ranked]

        def of_image(image_id: int, image: np.ndarray) -> Iterator[tuple]:
            h, w = image.shape
            seq = 0
            for rank, (region, x, y, width, height) in enumerate(regions):
                x0, y0 = min(int(x * w), w), min(int(y * h), h)
                part, hit = image[y0 : y0 + int(height * h), x0 : x0 + int(width * w)], False
                for method, detect in asked:
                    try:
                        found, error = [f for f in detect(part) if least <= max(f.w, f.h) <= most], None
                    except Exception as e:  # noqa: BLE001  a detector may raise anything
                        found, error = [], str(e) or type(e).__name__
                    if error:
                        yield image_id, seq, method, region, rank, None, None, None, None, 0.0, None, None, error
                        seq += 1
                    for f in found:
                        rows = None if f.modules is None else [int("".join("01"[bool(v)] for v in row), 2) for row in f.modules]
                        yield image_id, seq, method, region, rank, f.x, f.y, f.w, f.h, f.confidence, f.text, rows, None
                        seq, hit = seq + 1, True
                if hit:
                    return

        names_of = [c.split(" ")[0] for c in FOUND.split(", ")]
        greys = lambda p: np.frombuffer(p, np.uint8) if isinstance(p, bytes) else np.asarray(p)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = [r for k, h, w, p in zip(f["image_id"], f["height"], f["width"], f["pixels"], strict=True) for r in of_image(k, greys(p).reshape(h, w))]
                out = pd.DataFrame(rows, columns=names_of)
                yield out.astype({c: "Int32" for c in ("x", "y", "w", "h")})

        return images.select("image_id", "height", "width", "pixels").mapInPandas(run, FOUND)


def read(found: DataFrame) -> DataFrame:
    """What was found, with the texts of symbols that a detector gave as modules; unreadable ones have an error."""
    rows = symbols.decoded(found)
    data = F.coalesce("data", "decoded")
    why = F.coalesce("error_message", F.when(data.isNull(), F.col("decode_error")))
    return rows.withColumns({"data": data, "error_message": why}).drop("symbol", "decoded", "errors", "decode_error")


def _turned(symbol: pa.Array, turns: pa.Array) -> pa.Array:
    values, starts = symbols.listed(symbol)
    out, sides, often = values.astype(np.int64), np.diff(starts), np.asarray(pc.fill_null(turns, 0)) % 4
    for size in np.unique(sides[sides > 0]):
        for n in range(1, 4):
            at = starts[:-1][(sides == size) & (often == n)][:, None] + np.arange(size)
            bits = np.unpackbits(np.ascontiguousarray(out[at], ">i8").view(np.uint8), axis=1).reshape(-1, size, 64)
            bits[:, :, 64 - size :] = np.rot90(bits[:, :, 64 - size :], -n, axes=(1, 2))
            out[at] = np.packbits(bits.reshape(-1, size * 64), axis=1).view(">i8")
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out), mask=pc.is_null(symbol))


_turned_rows = F.arrow_udf(_turned, T.ArrayType(T.LongType()))


def turned(symbol: Column, turns: Column) -> Column:
    """A symbol after some quarter turns to the right."""
    return _turned_rows(symbol, turns.cast("int"))


#: Pages drawn at a time, so that a batch holds a few megabytes of pixels.
PAGES_AT_ONCE = 32


def printed(symbols_: DataFrame, width: int, height: int, box: int = 2) -> DataFrame:
    """Pages ``image_id, height, width, pixels`` (binary), each with a symbol at a place, each module a square of ``box`` pixels.

    Rows: ``image_id, symbol, x, y, ink, paper``; without a symbol a page is blank.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), PAGES_AT_ONCE):
                b = whole.slice(first, PAGES_AT_ONCE)
                values, starts = symbols.listed(b["symbol"])
                pages = []
                for k, (x, y, ink, paper) in enumerate(zip(*(b[c].to_pylist() for c in ("x", "y", "ink", "paper")), strict=True)):
                    rows, page = values[starts[k] : starts[k + 1]], np.full((height, width), paper, np.uint8)
                    if size := len(rows):
                        bits = np.unpackbits(rows.astype(">i8").view(np.uint8)).reshape(size, 64)[:, 64 - size :]
                        page[y : y + size * box, x : x + size * box] = np.where(bits, np.uint8(ink), np.uint8(paper)).repeat(box, axis=0).repeat(box, axis=1)
                    pages.append(page.tobytes())
                side = lambda n, pages=pages: pa.array([n] * len(pages), pa.int32())
                yield pa.RecordBatch.from_arrays([b["image_id"], side(height), side(width), pa.array(pages, pa.binary())], names=["image_id", "height", "width", "pixels"])

    number = lambda c: F.col(c).cast("int").alias(c)
    rows = symbols_.select(F.col("image_id").cast("long").alias("image_id"), "symbol", *map(number, ("x", "y", "ink", "paper")))
    return rows.mapInArrow(draw, "image_id long, height int, width int, pixels binary")
