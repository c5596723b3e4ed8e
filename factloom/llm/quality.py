"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from every whole text.  Trees are grown on a bounded sample of
labelled rows (:data:`SAMPLE` per class), then flattened into arrays so that a batch of
documents walks all trees at once in numpy.

Null text counts as the empty text, and the empty text has a score like any other.
Without labelled rows of both classes the score is the share of label 1 (0.5 without
any).  Rows are scored one by one, so repeated rows get equal scores; other columns of
the input are ignored or, in :func:`keep_good`, kept as they are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, sample_labels, unused, with_code

#: Labelled rows per class that the trees are grown on.
SAMPLE = 8000
#: A document is good from this score on.
THRESHOLD = 0.3
#: Remainder of crc32(doc_id) that labels are never learned from.
DIVISOR, HELD_OUT = 5, 0

_MARKS = [ord(mark) for mark in ".,;:!?|$%#*&@_-'\"/()<>"]


def statistics(text: str) -> list[float]:
    """The numbers that trees look at; shares are of bytes, words or lines."""
    data = text.encode("utf-8", "surrogatepass")
    size = max(1, len(data))
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = text.split()
    count = max(1, len(words))
    often = Counter(words)
    ordered = often.most_common(3)
    lines = text.split("\n")
    shares = seen[seen > 0] / size
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        len(text) / count,
        len(often) / count,
        ordered[0][1] / count if ordered else 0.0,
        sum(n for _, n in ordered) / count,
        sum(map(eq, words, words[1:])) / count,
        len(set(zip(words, words[1:]))) / count,
        len(zlib.compress(data, 1)) / size,
        float(-(shares * np.log2(shares)).sum()),
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        len(words) / len(lines),
        seen[65:91].sum() / size,
        seen[97:123].sum() / size,
        seen[48:58].sum() / size,
        seen[128:].sum() / size,
        (seen[9:14].sum() + seen[32]) / size,
        *(seen[_MARKS] / size),
    ]


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: arrays of shape (trees, nodes) and (trees, leaves)."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of statistics."""
        margin = np.full(len(rows), self.start)
        if len(self.leaf):
            trees = np.arange(len(self.leaf))
            node = np.zeros((len(rows), len(self.leaf)), dtype=np.int64)
            each = np.arange(len(rows))[:, None]
            for _ in range(int(np.log2(self.leaf.shape[1]))):
                value = rows[each, self.feature[trees, node]]
                node = 2 * node + 1 + (value > self.threshold[trees, node])
            margin += self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def grow(
    rows: np.ndarray,
    labels: np.ndarray,
    weights: np.ndarray,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    ridge: float = 1.0,
    least: float = 5.0,
) -> Forest:
    """Boost trees on the logistic loss, choosing splits from histograms of binned statistics."""
    nodes, leaves = 2**depth - 1, 2**depth
    total = weights.sum()
    share = (weights * labels).sum() / total if total else 0.5
    start = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if len(np.unique(labels)) < 2:
        return Forest(start, *(np.zeros((0, nodes)),) * 2, np.zeros((0, leaves)))
    columns = rows.shape[1]
    edges = np.quantile(rows, np.linspace(0, 1, bins + 1)[1:-1], axis=0)
    binned = np.stack([np.searchsorted(edges[:, c], rows[:, c]) for c in range(columns)], axis=1)
    feature = np.zeros((trees, nodes), dtype=np.int64)
    threshold = np.full((trees, nodes), np.inf)
    leaf = np.zeros((trees, leaves))
    margin = np.full(len(rows), start)
    for tree in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        slope, bend = weights * (labels - chance), weights * chance * (1 - chance)
        at = np.zeros(len(rows), dtype=np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best = np.full(wide, 1e-9)
            cut = np.full((wide, 2), -1)
            for column in range(columns):
                cell = (at - first) * bins + binned[:, column]
                g = np.bincount(cell, slope, wide * bins).reshape(wide, bins).cumsum(axis=1)
                h = np.bincount(cell, bend, wide * bins).reshape(wide, bins).cumsum(axis=1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = (
                    g**2 / (h + ridge)
                    + (g_all - g) ** 2 / (h_all - h + ridge)
                    - g_all**2 / (h_all + ridge)
                )
                gain[(h < least * 0.1) | (h_all - h < least * 0.1)] = 0
                gain[:, -1] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(wide), top] > best
                best[better] = gain[np.arange(wide), top][better]
                cut[better] = np.stack([np.full(wide, column), top], axis=1)[better]
            for node in np.flatnonzero(cut[:, 0] >= 0):
                feature[tree, first + node] = cut[node, 0]
                threshold[tree, first + node] = edges[cut[node, 1], cut[node, 0]]
            chosen = cut[at - first]
            right = (chosen[:, 0] >= 0) & (binned[np.arange(len(rows)), chosen[:, 0]] > chosen[:, 1])
            at = 2 * at + 1 + right
        g = np.bincount(at - nodes, slope, leaves)
        h = np.bincount(at - nodes, bend, leaves)
        leaf[tree] = rate * g / (h + ridge)
        margin += leaf[tree][at - nodes]
    return Forest(start, feature, threshold, leaf)


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(text or "") for text in texts], dtype=float)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Grow the trees; only statistics of the sampled rows reach the driver."""
    with_code(documents.sparkSession)
    chosen = sample_labels(labels, "quality", DIVISOR, HELD_OUT, sample)

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "label": batch["label"],
                    "weight": batch["weight"],
                    "numbers": list(_matrix(batch["text"])),
                }
            )

    # The sample is bounded, see above, so it may be broadcast and collected.
    known = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(chosen), "doc_id")
        .mapInPandas(numbers, "doc_id long, label int, weight double, numbers array<double>")
        .toPandas()
        .sort_values("doc_id", kind="stable")
    )
    width = len(statistics(""))
    rows = np.array([*known["numbers"]], dtype=float).reshape(-1, width)
    return grow(rows, known["label"].to_numpy(float), known["weight"].to_numpy(float))


def with_score(documents: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """All columns of ``documents`` and the score of the whole text."""
    with_code(documents.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(forest.score(_matrix(texts)) if len(texts) else [], dtype=float)

    return documents.withColumn(name, score(F.col("text").cast("string")))


def predictions(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    forest = train(documents, labels, sample)
    return with_score(documents.select("doc_id", "text"), forest).select(
        "doc_id",
        (remainder("doc_id", DIVISOR) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    name = unused(documents, "_quality_score")
    scored = with_score(documents, train(documents, labels, sample), name)
    return scored.filter(F.col(name) >= THRESHOLD).drop(name)
