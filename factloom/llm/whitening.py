"""Whitening of embeddings: eigenvectors in single precision, refined by matrix products.

Entries are first made integers, ``floor(scale * c) + shift``.  Sums and the products of the
covariance are then exact whatever the order in which tasks hand them in: one pass counts and
adds up, a second multiplies values from which the rounded mean was taken, and what rounding
left of the mean is taken off the result as a fraction of integers.

The covariance is small (width x width), so it is solved on the driver: eigenvectors in
float32, then the iterations of Ogita and Aishima in extended precision, each of which squares
the error with a few matrix products.  Eigenvalues that these can't tell apart form clusters;
a cluster is solved by itself, in the space of its vectors, with its middle taken off so that
its own differences fill the precision, and the iterations go on.

The driver gets at most :data:`MERGERS` states for each width, whatever the number of tasks.

Rows whose vector is null, or holds a null, a non-finite entry or one beyond ``2**33`` (no long
holds its products) are left out; so is a vector without entries, as it has no component.
Vectors of another length are another space, with a fit of their own.  Rows that repeat, or
have no id, count each.  Components without variance have a null ``whitened``: one row alone,
rows that are all equal, or more dimensions than rows.  ``deviation`` is null where a long is
too small for it.  An empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_code

SCALE, SHIFT = 64, 1_000_000
#: Entries of the result at most.
COMPONENTS = 32
#: Tasks that merge the states of all others.
MERGERS = 32
#: Largest entry that takes part.
LARGEST = float(2**33)
#: Variance below this share of all variance is none.
NOTHING = 1e-15
RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)

State = dict[int, Any]


def whole_vectors(embeddings: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and the integer vector ``x`` of the rows that take part."""
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)) & (F.size("v") > 0)
    entry = lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift)
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        .filter(F.col("v").isNotNull() & sound)
        .select("vec_id", F.transform("v", entry).alias("x"))
    )


def by_width(vectors: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, matrix) of the vectors of each width."""
    widths = vectors.map(len).to_numpy()
    for width in np.unique(widths):
        places = np.flatnonzero(widths == width)
        yield int(width), places, np.stack(vectors.to_numpy()[places]).astype(np.int64)


def gathered(
    rows: DataFrame, measure: Callable[[int, np.ndarray], Any], merge: Callable[[Any, Any], Any]
) -> State:
    """One state per width: batches are measured, and states merged, in tasks."""

    def add(states: State, width: int, state: Any) -> None:
        states[width] = merge(states[width], state) if width in states else state

    def packed(states: State) -> pd.DataFrame:
        return pd.DataFrame({"width": list(states), "state": [pickle.dumps(s) for s in states.values()]})

    def here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: State = {}
        for batch in batches:
            for width, _, matrix in by_width(batch["x"]):
                add(states, width, measure(width, matrix))
        yield packed(states)

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: State = {}
        for batch in batches:
            for width, state in zip(batch["width"], batch["state"]):
                add(states, width, pickle.loads(state))
        yield packed(states)

    schema = "width int, state binary"
    merged = (
        rows.select("x").mapInPandas(here, schema)
        .repartition(MERGERS, F.xxhash64("width", "state"))
        .mapInPandas(together, schema)
    )
    states: State = {}
    for row in merged.collect():
        add(states, row["width"], pickle.loads(row["state"]))
    return states


def totals(_: int, x: np.ndarray) -> tuple:
    """Rows, sums as Python integers, least and largest entry."""
    return len(x), x.sum(axis=0, dtype=object), x.min(), x.max()


def merged_totals(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3])


def products(y: np.ndarray, largest: int) -> np.ndarray:
    """The exact sum of products: by float64 where that is exact, else by Python integers."""
    rows = max(1, 2**53 // max(1, largest * largest))
    if rows >= 256:
        parts = [y[at : at + rows].astype(float) for at in range(0, len(y), rows)]
        return sum((p.T @ p).astype(np.int64).astype(object) for p in parts)
    y = y.astype(object)
    return y.T @ y


def covariance(n: int, rest: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """(n G - r r') / n^2 from exact integers, rounded once, in extended precision."""
    top = n * gram - np.outer(rest, rest)
    # An integer beyond 64 bits goes through two halves.
    high, low = top >> 32, top & 0xFFFFFFFF
    wide = np.longdouble
    return (high.astype(float).astype(wide) * wide(2**32) + low.astype(float).astype(wide)) / wide(n) / wide(n)


def eigen(a: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric matrix in extended precision."""
    size = len(a)
    scale = np.abs(a).max()
    if scale == 0:
        return np.zeros(size), np.eye(size)
    a = a / scale
    unit = np.eye(size, dtype=np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    largest = np.sqrt((a * a).sum())
    error, done = np.inf, np.finfo(np.longdouble).eps * 8 * size
    for _ in range(rounds):
        r, s = unit - x.T @ x, x.T @ a @ x
        # Even halves: what rounding makes uneven would be divided by the smallest gap.
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = np.sqrt(((s - np.diag(values)) ** 2).sum()) + largest * np.sqrt((r * r).sum())
        if off <= done or off > error / 2 and off < 1e-15:
            break
        error = off
        # Values nearer than this are not told apart yet.
        close = 2 * off
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > close
        step = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ step
        order = np.argsort(-values)
        x, values = x[:, order], values[order]
        ends = np.flatnonzero(np.append(values[:-1] - values[1:] > close, True)) + 1
        for start, end in zip(np.append(0, ends[:-1]), ends):
            if end - start > 1:
                x[:, start:end] = cluster(a, x[:, start:end], values[start:end].mean())
    values = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x * x).sum(axis=0))[order]
    return values[order] * scale, x


def cluster(a: np.ndarray, x: np.ndarray, middle: np.longdouble) -> np.ndarray:
    """The vectors of a cluster turned to its own eigenvectors."""
    inside = x.T @ (a @ x - middle * x)
    inside = (inside + inside.T) / 2
    spread = np.abs(inside).max()
    if spread == 0:
        return x
    turn = np.linalg.eigh((inside / spread).astype(np.float64))[1][:, ::-1].astype(np.longdouble)
    # One step makes it orthogonal to extended precision.
    turn = turn @ (np.eye(len(turn)) * np.longdouble(1.5) - turn.T @ turn / 2)
    return x @ turn


class Fit:
    """Mean and components of the vectors of one width."""

    def __init__(self, n: int, sums: np.ndarray, gram: np.ndarray, components: int) -> None:
        self.n = n
        self.centre, self.rest = centred(n, sums)
        v = covariance(n, self.rest, gram)
        values, vectors = eigen(v)
        keep = min(components, len(values))
        trace = np.trace(v)
        self.explained = np.zeros(keep) if trace == 0 else np.maximum(values[:keep] / trace, 0).astype(float)
        self.sound = self.explained > NOTHING
        scale = np.where(self.sound, 1 / np.sqrt(np.where(self.sound, values[:keep], 1)), np.nan)
        self.map = (vectors[:, :keep] * scale).astype(float)
        self.values, self.vectors = values.astype(float), vectors.astype(float)
        self.identity_error: float | None = None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        mean = (self.rest / self.n).astype(float)
        return ((x - self.centre) - mean) @ self.map

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Squared distance of n x from the sums: n x - S = n (x - centre) - rest."""
        y = x - self.centre
        most = self.n * int(np.abs(y).max()) + max(map(abs, map(int, self.rest)))
        if most * most * y.shape[1] < 2**63:
            away = self.n * y - self.rest.astype(np.int64)
            return [*map(int, (away * away).sum(axis=1))]
        away = self.n * y.astype(object) - self.rest
        return [value if value < 2**63 else None for value in (away * away).sum(axis=1)]


def centred(n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded mean, and the sums that are left once it is taken off every row."""
    centre = (2 * sums + n) // (2 * n)
    return centre.astype(np.int64), sums - n * centre


def fitted(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A :class:`Fit` per width over all rows of :func:`whole_vectors`."""
    spark = with_code(rows.sparkSession)
    sums = gathered(rows, totals, merged_totals)
    centres = {width: (centred(n, s)[0], int(high) - int(low) + 1) for width, (n, s, low, high) in sums.items()}
    sent = spark.sparkContext.broadcast(centres)

    def gram(width: int, x: np.ndarray) -> np.ndarray:
        centre, largest = sent.value[width]
        return products(x - centre, largest)

    grams = gathered(rows, gram, lambda a, b: a + b)
    fits = {width: Fit(*sums[width][:2], grams[width], components) for width in grams}
    models = spark.sparkContext.broadcast(fits)

    def moments(width: int, x: np.ndarray) -> tuple:
        """Rows, mean, and products of what is left when the mean is taken off."""
        fit = models.value[width]
        w = fit.whiten(x)[:, fit.sound]
        mean = w.mean(axis=0)
        return len(w), mean, (w - mean).T @ (w - mean)

    for width, (n, _, spread) in gathered(rows, moments, merged_moments).items():
        if len(spread):
            fits[width].identity_error = float(np.abs(spread / n - np.eye(len(spread))).max())
    return fits


def merged_moments(a: tuple, b: tuple) -> tuple:
    n, away = a[0] + b[0], b[1] - a[1]
    return n, a[1] + away * (b[0] / n), a[2] + b[2] + np.outer(away, away) * (a[0] * b[0] / n)


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per vector that takes part and component, see :data:`RESULT`."""
    rows = whole_vectors(embeddings)
    models = with_code(embeddings.sparkSession).sparkContext.broadcast(fitted(rows, components))

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, places, x in by_width(batch["x"]):
                fit = models.value[width]
                w = fit.whiten(x)
                keep, n = w.shape[1], len(w)
                values = pd.Series(w.ravel())
                out = pd.DataFrame(
                    {
                        "vec_id": batch["vec_id"].iloc[places].astype("Int64").repeat(keep).array,
                        "component": np.tile(np.arange(1, keep + 1, dtype=np.int32), n),
                        "n": fit.n,
                        "deviation": pd.array(fit.deviation(x), dtype="Int64").repeat(keep),
                        "whitened": values.astype("Float64").mask(values.isna()),
                        "explained": np.tile(fit.explained, n),
                    }
                )
                out["identity_error"] = np.nan if fit.identity_error is None else fit.identity_error
                yield out

    return rows.mapInPandas(turn, RESULT)
