"""Nearest neighbours by cosine: stable projections, kd-trees, and a chi-square stop.

Vectors of length one have squared distance 2 - 2 cosine, so the nearest are those of
largest cosine.  Gaussian projections are stable: the squared projected distance of two
vectors is their squared distance times a chi-square variable of ``DIMENSIONS`` degrees.
Neighbours in the projected space are therefore verified in order of projected distance,
until a vector as near as the k-th best found so far would have shown up with probability
``CONFIDENCE``; recall is about that.

Work is dealt in blocks.  The upper levels of the kd-tree cut the projected space into
cells of about :data:`CELL` vectors (from a bounded sample of :data:`SAMPLE` vectors);
each cell holds its own lower levels.  Every query searches its home cell first, which
gives a bound, then all cells within the radius that the bound leaves open.  Queries
travel in blocks of neighbouring home cells, so a task gets one cell and one block.

Equal vectors are one point that carries its smallest ids, as many as a result can use.
Vectors that are null, zero, or hold null or non-finite components take no part, neither
do rows without id.  Vectors of another length than most are no candidates of each other:
each length is searched by itself.  Rows that repeat an id with the same vector count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned, with_code

#: Degrees of the projections (even), and the chance that a neighbour has shown up.
DIMENSIONS, CONFIDENCE = 12, 0.98
#: Vectors per cell, rows of the sample that cells are cut by, and vectors per leaf.
CELL, SAMPLE, LEAF = 8192, 50_000, 64
#: Vectors of the sample that a cell should have.
SEEN = 16
#: Home cells whose queries travel together.
BLOCK = 32
#: Neighbours verified between two tests.
STEP = 256
SEED = 7


def chi_square(value: float, degrees: int = DIMENSIONS) -> float:
    """Distribution function for even degrees."""
    half, term, total = value / 2, 1.0, 0.0
    for j in range(degrees // 2):
        total += term
        term *= half / (j + 1)
    return 1 - exp(-half) * total


def quantile(share: float, degrees: int = DIMENSIONS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < share else (low, middle)
    return high


def projection(width: int) -> np.ndarray:
    """The same Gaussian directions for all vectors of one length."""
    return np.random.default_rng([SEED, width]).standard_normal((width, DIMENSIONS))


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


class Cells:
    """The upper levels of the tree: alternating median cuts of a sample."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.axis = np.zeros(2**depth, dtype=np.int64)
        self.cut = np.zeros(2**depth)
        self._split(1, sample)

    def _split(self, node: int, rows: np.ndarray) -> None:
        if node >= 2**self.depth:
            return
        axis = int(rows.var(axis=0).argmax()) if len(rows) else 0
        cut = float(np.median(rows[:, axis])) if len(rows) else 0.0
        self.axis[node], self.cut[node] = axis, cut
        self._split(2 * node, rows[rows[:, axis] <= cut])
        self._split(2 * node + 1, rows[rows[:, axis] > cut])

    def of(self, rows: np.ndarray) -> np.ndarray:
        node = np.ones(len(rows), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (rows[np.arange(len(rows)), self.axis[node]] > self.cut[node])
        return node - 2**self.depth

    def within(self, row: np.ndarray, radius: float) -> np.ndarray:
        """Cells that reach into the radius around ``row``, found from the root down."""
        node, gap = np.ones(1, dtype=np.int64), np.zeros((1, DIMENSIONS))
        for _ in range(self.depth):
            axis, cut = self.axis[node], self.cut[node]
            beyond = row[axis] - cut
            node = np.concatenate([2 * node, 2 * node + 1])
            gap = np.concatenate([gap, gap])
            # The far child is at least as far away along the axis as the cut is.
            each, axis = np.arange(len(node)), np.concatenate([axis, axis])
            away = np.concatenate([np.maximum(beyond, 0), np.maximum(-beyond, 0)])
            gap[each, axis] = np.maximum(gap[each, axis], away)
            near = (gap * gap).sum(axis=1) <= radius * radius
            node, gap = node[near], gap[near]
        return np.sort(node - 2**self.depth)


class Tree:
    """The lower levels: points of one cell in leaves with bounding boxes."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        leaves: list[np.ndarray] = []
        self._split(np.arange(len(points)), leaves)
        self.leaves = leaves
        self.low = np.array([points[leaf].min(axis=0) for leaf in leaves])
        self.high = np.array([points[leaf].max(axis=0) for leaf in leaves])

    def _split(self, rows: np.ndarray, leaves: list[np.ndarray]) -> None:
        if len(rows) <= LEAF:
            leaves.append(rows)
            return
        axis = int(np.ptp(self.points[rows], axis=0).argmax())
        order = np.argpartition(self.points[rows, axis], len(rows) // 2)
        self._split(rows[order[: len(rows) // 2]], leaves)
        self._split(rows[order[len(rows) // 2 :]], leaves)

    def nearest(self, row: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Points in order of distance, some at a time, with the squared distance that all
        later ones have at least."""
        gap = np.maximum(np.maximum(self.low - row, row - self.high), 0)
        bound = (gap * gap).sum(axis=1)
        order = np.argsort(bound, kind="stable")
        waiting, distance = np.zeros(0, dtype=np.int64), np.zeros(0)
        at, wide = 0, max(1, STEP // LEAF)
        while at < len(order):
            fresh = np.concatenate([self.leaves[leaf] for leaf in order[at : at + wide]])
            at += wide
            away = self.points[fresh] - row
            waiting = np.concatenate([waiting, fresh])
            distance = np.concatenate([distance, (away * away).sum(axis=1)])
            reach = bound[order[at]] if at < len(order) else np.inf
            ready = distance <= reach
            if ready.any():
                yield waiting[ready], reach
                waiting, distance = waiting[~ready], distance[~ready]


def search(
    tree: Tree, vectors: np.ndarray, query: np.ndarray, place: np.ndarray,
    k: int, bound: float, limit: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Points and cosines of the best of one cell; ``bound``: the k-th best distance elsewhere.

    Cosines of equal value at the end of the list all stay, for ties.
    """
    norm = sqrt(float(query @ query))
    found, score = np.zeros(0, dtype=np.int64), np.zeros(0)
    for points, reach in tree.nearest(place):
        some = vectors[points]
        cosine = (some @ query) / (np.sqrt((some * some).sum(axis=1)) * norm)
        found, score = np.concatenate([found, points]), np.concatenate([score, cosine])
        if len(score) > k:
            least = np.partition(score, -k)[-k]
            keep = score >= least - 1e-12
            found, score = found[keep], score[keep]
            bound = min(bound, max(0.0, 2 - 2 * float(least)))
        if reach > limit * bound:
            break
    return found, score


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row whose id ``every`` divides."""
    spark = with_code(embeddings.sparkSession)
    limit = quantile(CONFIDENCE)
    vector = F.col("embedding").cast("array<double>")
    sound = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists("vector", lambda x: x != 0)
    rows = (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .filter(sound)
        .withColumn("key", F.sha2(F.concat_ws(",", F.transform("vector", lambda x: x.cast("string"))), 256))
    )

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: units(np.array([v], dtype=float))[0] @ projection(len(v)))

    # As many ids of equal vectors as a result can use: k, and one for the query itself.
    few = Window.partitionBy("key").orderBy("vec_id")
    used = (
        rows.select("key", "vec_id").distinct()
        .withColumn("at", F.row_number().over(few)).filter(F.col("at") <= k + 1)
        .groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    points = pinned(
        rows.groupBy("key").agg(F.first("vector").alias("vector"))
        .join(used, "key")
        .select("ids", "vector", F.size("vector").alias("width"), project("vector").alias("place"))
    )
    queries = pinned(
        rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
        .select("vec_id", "vector").dropDuplicates(["vec_id"])
        .select(F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("width"), project("vector").alias("place"))
    )
    cells: dict[int, Cells] = {}
    for row in points.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect():
        share = min(1.0, SAMPLE / row["n"])
        drawn = points.filter(F.col("width") == row["width"]).filter(
            F.pmod(F.xxhash64("ids"), F.lit(1_000_000)) < 1_000_000 * share
        )
        sample = np.array([r["place"] for r in drawn.select("place").collect()], dtype=float)
        # Cells grow beyond CELL where the sample is too small to cut them finer.
        depth = int(np.ceil(np.log2(max(1, min(row["n"] / CELL, len(sample) / SEEN)))))
        cells[row["width"]] = Cells(sample.reshape(-1, DIMENSIONS), depth)
    sent = spark.sparkContext.broadcast(cells)

    @F.pandas_udf("int")
    def cell_of(width: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(
            [int(sent.value[w].of(np.array([p]))[0]) if w in sent.value else 0 for w, p in zip(width, place)],
            dtype=int,
        )

    @F.pandas_udf("array<int>")
    def open_cells(width: pd.Series, place: pd.Series, bound: pd.Series, home: pd.Series) -> pd.Series:
        found = []
        for w, p, b, h in zip(width, place, bound, home):
            all_ = sent.value[w].within(np.array(p), sqrt(limit * b)) if w in sent.value else np.zeros(0, int)
            found.append([int(cell) for cell in all_ if cell != h])
        return pd.Series(found)

    homed = pinned(queries.withColumn("home", cell_of("width", "place")))
    housed = pinned(points.withColumn("cell", cell_of("width", "place")))

    def look(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Best candidates of one block of queries in one cell."""
        out = []
        if len(left) and len(right):
            vectors = np.array([*right["vector"]], dtype=float)
            tree = Tree(np.array([*right["place"]], dtype=float))
            ids = list(right["ids"])
            for query_id, query, place, bound in zip(left["query_id"], left["vector"], left["place"], left["bound"]):
                query = np.array(query, dtype=float)
                # One point may be the query itself.
                found, score = search(tree, vectors, query, np.array(place), k + 1, bound, limit)
                for at, value in zip(found, score):
                    out += [(query_id, i, value) for i in ids[at] if i != query_id]
        found = pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
        return found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby(
            "query_id"
        ).head(k)

    def searched(asked: DataFrame) -> DataFrame:
        """Candidates of (queries with bound, cell), in blocks of queries from near cells."""
        asked = asked.withColumn("block", F.floor(F.col("home") / BLOCK).cast("int"))
        wanted = asked.select(
            F.col("width").alias("in_width"), F.col("cell").alias("in_cell"), F.col("block").alias("for_block")
        ).distinct()
        given = housed.join(
            wanted, (F.col("width") == F.col("in_width")) & (F.col("cell") == F.col("in_cell"))
        ).select("in_width", "in_cell", "for_block", "ids", "vector", F.col("place"))
        return (
            asked.select("width", "cell", "block", "query_id", "vector", "place", "bound")
            .groupBy("width", "cell", "block")
            .cogroup(given.groupBy("in_width", "in_cell", "for_block"))
            .applyInPandas(look, "query_id long, vec_id long, score double")
        )

    near = pinned(searched(homed.withColumn("cell", F.col("home")).withColumn("bound", F.lit(4.0))))
    worst = near.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.greatest(F.lit(0.0), 2 - 2 * F.min("score"))).otherwise(4.0).alias("bound")
    )
    further = (
        homed.join(worst, "query_id", "left")
        .withColumn("bound", F.coalesce("bound", F.lit(4.0)))
        .withColumn("cell", F.explode(open_cells("width", "place", "bound", "home")))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.unionByName(searched(further))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
