"""Main text of web pages by gradient-boosted trees over DOM nodes.

Trees score every block element and text run by what it is, what stands above
it, how dense its subtree is and how it compares to its siblings. A dynamic
programme then picks the likeliest set of nodes to keep among those in which
nothing is kept below a node that is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysheet.llm.common import small_batches
from tallysheet.llm.dom import Page, parse
from tallysheet.llm.pages_gen import MARK, make_page

#: Pages to train on, trees, their depth, learning rate, L2 on leaves, least nodes behind a token, cuts of a measure.
PAGES, TREES, DEPTH, RATE, RIDGE, LEAST, CUTS = 1200, 80, 5, 0.25, 1.0, 8, 12
#: Nodes whose features are laid out at a time.
NODES = 1 << 14


def below(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values over each node and all below it, for nodes in page order."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[end] - total[np.arange(len(values))]


class Forest:
    """Arrays over the nodes of several pages, one page after another."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tags) for p in pages])
        starts = np.cumsum(sizes) - sizes
        flat = lambda name, kind: np.array([x for p in pages for x in getattr(p, name)], kind)
        self.page = np.repeat(np.arange(len(pages)), sizes)
        self.start = np.repeat(starts, sizes)
        self.root = np.arange(len(self.page)) == self.start
        self.parent = np.where(self.root, -1, flat("parents", np.int64) + self.start)
        self.up = np.where(self.root, np.arange(len(self.page)), self.parent)
        self.depth, self.end = flat("depths", np.int64), flat("end", np.int64) + self.start
        self.tags = [t for p in pages for t in p.tags]
        self.tokens = [t for p in pages for t in p.tokens]
        self.texts = [t for p in pages for t in p.texts]
        self.linked = flat("linked", np.float64)

    def levels(self) -> Iterator[np.ndarray]:
        """Nodes by depth, the roots first."""
        order = np.argsort(self.depth, kind="stable")
        yield from np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)

    def measures(self) -> np.ndarray:
        """Subtree density, page share, place, depth and sibling statistics of each node."""
        n = len(self.page)
        own = np.fromiter((len(t) for t in self.texts), np.float64, n)
        stops = np.fromiter((t.count(".") + t.count(",") for t in self.texts), np.float64, n)
        text, links, marks = below(own, self.end), below(self.linked, self.end), below(stops, self.end)
        nodes = (self.end - np.arange(n)).astype(float)
        leaves = below((own > 0).astype(float), self.end)
        whole, total = text[self.start], nodes[self.start]
        before = np.cumsum(own) - own
        before -= before[self.start]
        siblings = np.bincount(self.up[~self.root], minlength=n)[self.up]
        mean = text[self.up] / np.maximum(siblings, 1)
        return np.stack(
            [
                text, links / np.maximum(text, 1), marks / np.maximum(text, 1), text / np.maximum(leaves, 1), text / nodes, leaves, nodes,
                text / np.maximum(whole, 1), before / np.maximum(whole, 1), (np.arange(n) - self.start) / total, self.depth, siblings,
                text / np.maximum(mean, 1), text / np.maximum(text[self.up], 1), text[self.up], links[self.up] / np.maximum(text[self.up], 1), text[self.up[self.up]] / np.maximum(whole, 1), whole,
            ], axis=1,
        )


@dataclass
class Extractor:
    """Names that are features, the cuts of the measures, and the trees: in each inner place a feature, in each leaf a value."""

    names: dict[str, int]
    cuts: list[np.ndarray]
    feature: np.ndarray
    value: np.ndarray

    def packed(self, forest: Forest) -> np.ndarray:
        """Own names and names above of each node, a bit each: a page of a million nodes stays small."""
        n, m = len(forest.page), len(self.names)
        own = np.zeros((n, (m + 7) // 8), np.uint8)
        get = self.names.get
        at = [(i, k) for i, (tag, tokens) in enumerate(zip(forest.tags, forest.tokens, strict=True)) for k in (get("<" + tag), *map(get, tokens)) if k is not None]
        if at:
            i, k = np.array(at).T
            np.bitwise_or.at(own, (i, k >> 3), (1 << (k & 7)).astype(np.uint8))
        above = np.zeros_like(own)
        for level in forest.levels():
            level = level[~forest.root[level]]
            above[level] = above[forest.parent[level]] | own[forest.parent[level]]
        return np.stack([own, above], axis=1)

    def matrix(self, packed: np.ndarray, measures: np.ndarray) -> np.ndarray:
        """Yes-or-no features of some nodes: own names, names above, measures over each cut."""
        own, above = (np.unpackbits(packed[:, k], axis=1, count=len(self.names), bitorder="little").astype(bool) for k in (0, 1))
        return np.concatenate([own, above, *[measures[:, [k]] > c[None, :] for k, c in enumerate(self.cuts)]], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value in zip(self.feature, self.value, strict=True):
            place = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                place = 2 * place + 1 + x[rows, feature[place]]
            out += value[place - (2**DEPTH - 1)]
        return out

    @classmethod
    @cache
    def train(cls, pages: int = PAGES) -> Extractor:
        """A model from made-up pages. They come from seeds, so it is always the same, and a driver trains it once."""
        parsed = [parse(make_page(seed)) for seed in range(pages)]
        marked = np.array([MARK in t for p in parsed for t in p.texts], float)
        forest = Forest(parsed)
        y = (below(marked, forest.end) > 0).astype(float)
        met: dict[str, int] = {}
        for tag, tokens in zip(forest.tags, forest.tokens, strict=True):
            for t in ("<" + tag, *tokens):
                met[t] = met.get(t, 0) + 1
        names = {t: k for k, t in enumerate(sorted(t for t, c in met.items() if c >= LEAST))}
        x = forest.measures()
        cuts = [np.unique(np.quantile(x[:, k], np.arange(1, CUTS + 1) / (CUTS + 1))) for k in range(x.shape[1])]
        model = cls(names, cuts, np.zeros((TREES, 2**DEPTH - 1), np.int64), np.zeros((TREES, 2**DEPTH)))
        x = model.matrix(model.packed(forest), x)
        dense, out = x.astype(np.float32), np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(TREES):
            p = 1 / (1 + np.exp(-out))
            g, h = (p - y).astype(np.float32), (p * (1 - p)).astype(np.float32)
            place = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                inside = np.zeros((len(x), width), np.float32)
                inside[rows, place - first] = 1
                gs, hs = (inside * g[:, None]).T, (inside * h[:, None]).T
                g1, h1, ga, ha = gs @ dense, hs @ dense, gs.sum(axis=1)[:, None], hs.sum(axis=1)[:, None]
                gain = g1**2 / (h1 + RIDGE) + (ga - g1) ** 2 / (ha - h1 + RIDGE)
                gain[(h1 < 0.5) | (ha - h1 < 0.5)] = -1
                model.feature[t, first : first + width] = gain.argmax(axis=1)
                place = 2 * place + 1 + x[rows, model.feature[t][place]]
            place -= 2**DEPTH - 1
            model.value[t] = -RATE * np.bincount(place, g, 2**DEPTH) / (np.bincount(place, h, 2**DEPTH) + RIDGE)
            out += model.value[t][place]
        return model

    def keep(self, forest: Forest) -> np.ndarray:
        """Nodes to keep: the likeliest choice in which all nodes above a kept one are kept."""
        packed, measures = self.packed(forest), forest.measures()
        logits = np.concatenate([self.logits(self.matrix(packed[i : i + NODES], measures[i : i + NODES])) for i in range(0, len(packed), NODES)])
        # In logits, dropping a whole subtree is worth nothing; keeping a node is worth its logit and the best of its children.
        worth = logits.copy()
        levels = list(forest.levels())
        for level in levels[::-1]:
            level = level[~forest.root[level]]
            np.add.at(worth, forest.parent[level], np.maximum(worth[level], 0))
        kept = np.zeros(len(worth), bool)
        for level in levels:
            kept[level] = forest.root[level] | ((worth[level] > 0) & kept[forest.up[level]])
        return kept

    def extract(self, sources: list[str | None]) -> list[str]:
        """Main text of each page: its kept text runs, joined by an empty line; empty if none."""
        forest = Forest([parse(s) for s in sources])
        out: list[list[str]] = [[] for _ in sources]
        if len(forest.page):
            for i in np.flatnonzero(self.keep(forest)):
                if forest.texts[i]:
                    out[forest.page[i]].append(forest.texts[i])
        return ["\n\n".join(blocks) for blocks in out]

    def column(self, spark: SparkSession, source: Column | str) -> Column:
        shared = spark.sparkContext.broadcast(self)
        small_batches(spark)

        @F.pandas_udf(T.StringType())
        def extracted(sources: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in sources:
                parts = [shared.value.extract(list(batch[i : i + 200])) for i in range(0, len(batch), 200)]
                yield pd.Series([t for part in parts for t in part], dtype=object)

        return extracted(source)


def extract_pages(pages: DataFrame, model: Extractor | None = None) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` (code points).

    Null and empty pages, and pages without main text, have an empty text and 0.
    Rows alike stay apart; an empty table gives no rows; further columns are
    ignored.
    """
    model = model or Extractor.train()
    found = pages.select("page_id", "url", model.column(pages.sparkSession, F.col("html").cast("string")).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every page's main text."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
