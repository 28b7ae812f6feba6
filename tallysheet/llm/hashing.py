"""Hashed words and character n-grams of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Base of the rolling hash (odd, so it has an inverse modulo 2**64), and the factor that mixes its bits.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Code points handled at once; a chunk ends at white space, so a word is only cut if it is longer than a chunk.
CHUNK = 1 << 18


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for a chunk and what it looks ahead."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    n = 2 * CHUNK + 16
    with np.errstate(over="ignore"):
        up, down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (BASE, inverse))
    return up, down


def chunks(text: str, ahead: int) -> Iterator[tuple[str, int]]:
    """Slices of a text with how many of their code points count; the rest is what the last n-grams look ahead to."""
    start = 0
    while start < len(text):
        end = min(len(text), start + CHUNK)
        if end < len(text):
            space = max(text.rfind(" ", start + CHUNK // 2, end), text.rfind("\n", start + CHUNK // 2, end))
            end = space + 1 if space >= 0 else end
        yield text[start : end + ahead], end - start
        start = end


def hashed(text: str, sizes: tuple[int, ...], bits: int, words: bool = False) -> Iterator[np.ndarray]:
    """Buckets (below ``2**bits``) of every n-gram of the given sizes and, if asked for, of every word."""
    up, down = powers()
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        for part, own in chunks(text, max(sizes) - 1):
            c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            total = np.concatenate([[np.uint64(0)], np.cumsum((c + np.uint64(1)) * up[: len(c)])])
            for n in sizes:
                m = min(own, len(c) - n + 1)
                if m > 0:
                    yield ((((total[n : n + m] - total[:m]) * down[:m]) + np.uint64(n)) * MIX >> shift).astype(np.int64)
            if words:
                c = c[:own]
                blank = np.concatenate([[True], (c == 32) | ((c >= 9) & (c <= 13)), [True]])
                edge = np.flatnonzero(blank[1:] != blank[:-1])
                s, e = edge[::2], edge[1::2]
                if len(s):
                    whole = (total[e] - total[s]) * down[s]
                    yield ((whole + np.uint64(99)) * MIX >> shift).astype(np.int64)


def counted(text: str, sizes: tuple[int, ...], bits: int, words: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    parts = list(hashed(text, sizes, bits, words))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    found, n = np.unique(np.concatenate(parts), return_counts=True)
    return found, n.astype(float)
