"""Hard negatives by inner product, searched in length buckets with sorted coordinate lists.

Vectors become integers, so every score is exact.  The score of an anchor q and a row x is
|q| |x| cos; of rows no longer than l only those with cos >= t = bound / (|q| l) can reach a
bound.  Rows are therefore sorted by length and cut into buckets (:class:`Bucket`): a bucket
with t > 1 is passed over, and in any other each of the anchor's :data:`FOCUS` largest
coordinates leaves a range of values that a row of cos >= t can have there.  A bucket holds a
sorted list of each coordinate; the shortest of the ranges gives candidates, the other ranges
cut them down, and only what is left is scored.  Where ranges leave most of a bucket, all its
rows are scored at once by a matrix product, which is the cheaper way to the same rows.

Buckets lie in parts of about :data:`PART` rows, anchors travel in blocks of :data:`BLOCK`; a
task gets one part and one block.  Every anchor first searches its own part for positives,
which gives a bound, then the parts that hold its label and can reach the bound.  Positives
give the band of scores in which negatives lie: from four fifths of the positive score up to
it.  All bounds rise as rows are found, nothing is capped, and ties stay.

Equal vectors of one label are one point with its smallest ids, as many as a result can use,
so copies are scored once, and anchors that are copies are searched once.

Rows whose label, id or vector is null, or whose vector holds a null or non-finite component
or is so long that a score might not fit a long (integer length above 2**29), take no part.
Vectors of another length are no candidates of each other.  Rows that repeat count once; rows
of one id that differ in vector or label count each by itself.  Vectors of length zero score 0
with all.  An empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned, with_code

#: What a component is multiplied by.
SCALE = 256.0
#: Vectors of a part, anchors of a block, and rows of a bucket.
PART, BLOCK, BUCKET = 32_768, 16_384, 1024
#: Anchors scored at once, and their coordinates that are looked at.
CHUNK, FOCUS = 256, 4
#: Ranges that leave more than this share of a bucket are not worth intersecting.
DENSE = 0.25
#: Longest vector that takes part, and a bound that every score reaches.
LONGEST, LEAST = 2.0**29, -(2**62)
#: Room for rounding in ranges of coordinates.
SLACK = 1e-9


class Bucket:
    """Rows of similar length with a sorted list of each coordinate."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> None:
        self.vectors, self.labels = vectors, labels
        self.length = float(lengths.max())
        self.one_label = labels[0] if (labels == labels[0]).all() else None
        self.units = vectors / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(self.units, axis=0)
        self.lists = np.take_along_axis(self.units, self.order, axis=0)

    def ranges(self, focus: np.ndarray, units: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest value in each focus coordinate of a row with cosine ``t`` or more.

        Angles obey the triangle inequality: a row within acos(t) of the anchor is, seen
        from an axis, within acos(t) of the anchor's angle.
        """
        reach = np.arccos(np.clip(t, -1, 1))[:, None]
        angle = np.arccos(np.clip(np.take_along_axis(units, focus, axis=1), -1, 1))
        low = np.cos(np.minimum(angle + reach, np.pi)) - SLACK
        return low, np.cos(np.maximum(angle - reach, 0)) + SLACK

    def places(self, focus: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where these ranges begin and end in the sorted lists."""
        start, end = np.zeros_like(focus), np.zeros_like(focus)
        for f in np.unique(focus):
            here = focus == f
            start[here] = np.searchsorted(self.lists[:, f], low[here], "left")
            end[here] = np.searchsorted(self.lists[:, f], high[here], "right")
        return start, end

    def candidates(self, focus, low, high, start, end) -> np.ndarray:
        """Rows in the ranges of one anchor: the shortest list, cut down by the others."""
        first = int((end - start).argmin())
        rows = self.order[start[first] : end[first], focus[first]]
        for k, f in enumerate(focus):
            if k != first and len(rows):
                value = self.units[rows, f]
                rows = rows[(value >= low[k]) & (value <= high[k])]
        return rows


class Anchors:
    """Anchors as arrays, with bounds that rise as rows are found."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, low: np.ndarray) -> None:
        self.vectors, self.labels, self.low = vectors, labels, low
        self.lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        self.units = vectors / np.maximum(self.lengths, 1e-300)[:, None]
        few = min(FOCUS, vectors.shape[1])
        self.focus = np.argsort(-np.abs(self.units), axis=1, kind="stable")[:, :few]


def scored(anchors: Anchors, some: np.ndarray, bucket: Bucket, same: bool) -> tuple[np.ndarray, ...]:
    """(anchor, row, score) of a bucket's rows of the same label, or another, that reach the bound.

    ``some`` are places of anchors.  The count of scored pairs comes last.
    """
    none = np.zeros(0, dtype=np.int64)
    if bucket.one_label is not None:
        some = some[(anchors.labels[some] == bucket.one_label) == same]
    low = anchors.low[some].astype(float)
    scale = anchors.lengths[some] * bucket.length
    t = np.where((low > 0) & (scale > 0), low / np.maximum(scale, 1e-300), np.where(low > 0, 2.0, -1.0))
    some, t = some[t <= 1 + SLACK], t[t <= 1 + SLACK]
    if not len(some):
        return none, none, none, 0
    focus = anchors.focus[some]
    low, high = bucket.ranges(focus, anchors.units[some], t)
    start, end = bucket.places(focus, low, high)
    left = (end - start).min(axis=1, initial=len(bucket.vectors))
    dense = left > DENSE * len(bucket.vectors)
    found = []
    exact = anchors.lengths[some].max() * bucket.length < 2**52
    kind = np.float64 if exact else np.int64  # products below 2**53 are exact in float64
    rows = bucket.vectors.astype(kind)
    counted = 0
    full = some[dense]
    if len(full):
        score = (anchors.vectors[full].astype(kind) @ rows.T).astype(np.int64)
        counted += score.size
        alike = anchors.labels[full][:, None] == bucket.labels[None, :]
        at, row = np.nonzero((score >= anchors.low[full][:, None]) & (alike == same))
        found.append((full[at], row, score[at, row]))
    for k in np.flatnonzero(~dense):
        row = bucket.candidates(focus[k], low[k], high[k], start[k], end[k])
        row = row[(bucket.labels[row] == anchors.labels[some[k]]) == same]
        score = (rows[row] @ anchors.vectors[some[k]].astype(kind)).astype(np.int64)
        counted += len(row)
        good = score >= anchors.low[some[k]]
        found.append((np.full(good.sum(), some[k]), row[good], score[good]))
    return (*(np.concatenate([f[j] for f in found]) for j in range(3)), counted)


def best(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: higher scores first, ties by smaller id, pairs once."""
    order = np.lexsort((vec_id, -score, group))
    g, s, v = group[order], score[order], vec_id[order]
    fresh = np.ones(len(g), dtype=bool)
    fresh[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (v[1:] != v[:-1])
    order, g = order[fresh], g[fresh]
    begins = np.ones(len(g), dtype=bool)
    begins[1:] = g[1:] != g[:-1]
    starts = np.flatnonzero(begins)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[rank < k]


class Found:
    """The first k rows of each group so far."""

    def __init__(self, groups: int, k: int) -> None:
        self.groups, self.k = groups, k
        self.rows = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        joined = [np.concatenate(pair) for pair in zip(self.rows, (group, score, vec_id))]
        kept = best(*joined, self.k)
        self.rows = tuple(column[kept] for column in joined)

    def worst(self) -> np.ndarray:
        """The k-th score of each group, or :data:`LEAST` while it has fewer."""
        out = np.full(self.groups, LEAST, dtype=np.int64)
        full = np.bincount(self.rows[0], minlength=self.groups) >= self.k
        lowest = np.full(self.groups, -LEAST, dtype=np.int64)
        np.minimum.at(lowest, self.rows[0], self.rows[1])
        out[full] = lowest[full]
        return out


class Part:
    """Points of one part in buckets, longest first inside a label."""

    def __init__(self, points: pd.DataFrame) -> None:
        points = points.sort_values(["label", "length"], ascending=[True, False], kind="stable")
        self.ids = list(points["ids"])
        self.count = np.array([len(i) for i in self.ids])
        self.flat, self.first = np.concatenate(self.ids), np.append(0, np.cumsum(self.count))
        vectors = np.stack(points["x"].to_numpy()).astype(np.int64)
        labels, lengths = points["label"].to_numpy(), points["length"].to_numpy()
        cuts = range(0, len(points), BUCKET)
        self.starts = list(cuts)
        self.buckets = [Bucket(vectors[c : c + BUCKET], labels[c : c + BUCKET], lengths[c : c + BUCKET]) for c in cuts]
        self.scored = 0

    def with_ids(self, row: np.ndarray, *carried: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each point's ids as rows, with the carried columns."""
        times = self.count[row]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return self.flat[np.repeat(self.first[row], times) + inside], *(np.repeat(c, times) for c in carried)

    def search(self, anchors: Anchors, same: bool, found: Found, requests: np.ndarray | None = None) -> None:
        """Add what the buckets hold.  ``requests``: positive scores of each anchor, -1 for none.

        Without requests a group of ``found`` is an anchor, else an anchor and its request.
        """
        for base in range(0, len(anchors.vectors), CHUNK):
            some = np.arange(base, min(base + CHUNK, len(anchors.vectors)))
            for start, bucket in zip(self.starts, self.buckets):
                at, row, score, counted = scored(anchors, some, bucket, same)
                self.scored += counted
                if not len(at):
                    continue
                if requests is None:
                    vec_id, at, score = self.with_ids(row + start, at, score)
                    found.add(at, score, vec_id)
                    anchors.low[some] = np.maximum(anchors.low[some], found.worst()[some])
                    continue
                wide = requests.shape[1]
                asked = requests[at]
                pair, j = np.nonzero((score[:, None] <= asked) & (5 * score[:, None] >= 4 * asked))
                vec_id, group, score = self.with_ids(row[pair] + start, at[pair] * wide + j, score[pair])
                found.add(group, score, vec_id)
                reached = np.maximum(found.worst().reshape(-1, wide)[some], floor_of(requests[some]))
                reached = np.where(requests[some] < 0, -LEAST, reached)
                anchors.low[some] = np.maximum(anchors.low[some], reached.min(axis=1))


def floor_of(positive):
    """The least negative score for a positive one: 100 negative >= 80 positive."""
    return -(-4 * positive // 5)


def points_of(embeddings: DataFrame, ids: int) -> tuple[DataFrame, DataFrame]:
    """(rows: key, vec_id; points: key, label, width, length, x, ids with the smallest ids)."""
    rows = (
        embeddings.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
            F.col("embedding").cast("array<double>").alias("v"),
        )
        .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
        .filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE <= LONGEST)))
        .select(
            "vec_id",
            F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
            F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"),
        )
        .withColumn("length", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c)))
        .filter(F.col("length") <= LONGEST)
        .withColumn("key", F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join("x", ",")), 256))
    )
    narrow = rows.select("key", "vec_id").distinct()
    order = Window.partitionBy("key").orderBy("vec_id")
    smallest = (
        narrow.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= ids)
        .groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    once = rows.groupBy("key").agg(*[F.first(name).alias(name) for name in ("label", "length", "x")])
    return rows, once.join(smallest, "key").withColumn("width", F.size("x"))


def mined(embeddings: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id ``every`` divides.  Of each, the ``positives`` best rows of its
    label, and for each of these the ``negatives`` best rows of other labels whose score is at
    most that of the positive and at least four fifths of it.
    """
    spark = with_code(embeddings.sparkSession)
    rows, points = points_of(embeddings, max(positives, negatives) + 1)
    count = rows.count()
    parts = max(1, -(-count // PART))
    placed = pinned(
        points.repartitionByRange(parts, "width", "label", "length", "key").withColumn("part", F.spark_partition_id())
    )
    sides = [
        (r["part"], r["width"], r["low"], r["high"], r["longest"])
        for r in placed.groupBy("part", "width").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.max("length").alias("longest")
        ).collect()
    ]
    sent = spark.sparkContext.broadcast(sides)
    asking = pinned(rows.filter(F.col("vec_id") % every == 0).select("key", F.col("vec_id").alias("anchor_id")).distinct())
    anchors = pinned(placed.drop("ids").join(asking.select("key").distinct(), "key", "left_semi"))
    blocks = max(1, -(-count // every // BLOCK))

    @F.pandas_udf("array<int>")
    def open_parts(
        width: pd.Series, label: pd.Series, length: pd.Series, low: pd.Series, home: pd.Series, same: pd.Series
    ) -> pd.Series:
        """Parts that may hold rows of the same label (but for the home part), or of another, and reach the bound."""
        part, wide, least, most, longest = (np.array(c) for c in zip(*sent.value))
        out = []
        for w, a, n, b, h, s in zip(width, label, length, low, home, same):
            holds = (part != h) & (least <= a) & (a <= most) if s else (least != a) | (most != a)
            reach = n * longest * (1 + SLACK) >= b if b > 0 else np.ones(len(part), dtype=bool)
            out.append(part[holds & reach & (wide == w)])
        return pd.Series(out)

    def dealt(asked: DataFrame, look, schema: str) -> DataFrame:
        """Hand each task one part and one block of the anchors that go there."""
        asked = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
        wanted = asked.select(
            F.col("part").alias("in_part"), F.col("width").alias("in_width"), F.col("block").alias("for_block")
        ).distinct()
        names = ["label", "length", "x", "ids"]
        given = placed.join(
            wanted, (F.col("part") == F.col("in_part")) & (F.col("width") == F.col("in_width"))
        ).select("in_part", "in_width", "for_block", *[F.col(name).alias(f"of_{name}") for name in names])
        return (
            asked.groupBy("part", "width", "block")
            .cogroup(given.groupBy("in_part", "in_width", "for_block"))
            .applyInPandas(look, schema)
        )

    def part_of(right: pd.DataFrame) -> Part:
        return Part(right.rename(columns=lambda name: name.removeprefix("of_")))

    def anchors_of(left: pd.DataFrame) -> Anchors:
        return Anchors(
            np.stack(left["x"].to_numpy()).astype(np.int64), left["label"].to_numpy(), left["low"].to_numpy().copy()
        )

    def look_same(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = Found(len(left), positives + 1)
        if len(left) and len(right):
            part_of(right).search(anchors_of(left), True, found)
        at, score, vec_id = found.rows
        return pd.DataFrame({"key": left["key"].to_numpy()[at], "score": score, "vec_id": vec_id})

    def look_other(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        wide = max(map(len, left["scores"]), default=1)
        requests = np.array([[*s, *[-1] * (wide - len(s))] for s in left["scores"]], dtype=np.int64).reshape(-1, wide)
        found = Found(len(left) * wide, negatives)
        if len(left) and len(right):
            part_of(right).search(anchors_of(left), False, found, requests)
        at, score, vec_id = found.rows
        return pd.DataFrame(
            {
                "key": left["key"].to_numpy()[at // wide], "positive_score": requests.ravel()[at],
                "score": score, "vec_id": vec_id,
            }
        )

    def first(frame: DataFrame, keys: list[str], k: int) -> DataFrame:
        """One row per key with the list ``best`` of its k first (score, vec_id)."""
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        ranked = frame.distinct().withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)
        return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "score", "vec_id"))).alias("best"))

    alike = "key string, score long, vec_id long"
    near = pinned(dealt(anchors.withColumn("low", F.lit(LEAST)), look_same, alike))
    worst = near.groupBy("key").agg(
        F.when(F.count(F.lit(1)) > positives, F.min("score")).otherwise(F.lit(LEAST)).alias("low")
    )
    opened = lambda frame, same: frame.withColumn(
        "part", F.explode(open_parts("width", "label", "length", "low", "part", F.lit(same)))
    )
    further = anchors.join(worst, "key", "left").withColumn("low", F.coalesce("low", F.lit(LEAST)))
    everything = near.unionByName(dealt(opened(further, True), look_same, alike))
    # The anchor itself may be among the best of its point, so one more was kept.
    chosen = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("anchor_id")), 1, positives)
    paired = pinned(
        asking.join(first(everything, ["key"], positives + 1), "key")
        .select("key", "anchor_id", F.explode(chosen).alias("b"))
        .select("key", "anchor_id", F.col("b.vec_id").alias("positive_id"), F.col("b.score").alias("positive_score"))
    )
    requests = (
        paired.filter(F.col("positive_score") >= 0).groupBy("key").agg(F.collect_set("positive_score").alias("scores"))
        .withColumn("low", F.ceil(F.array_min("scores") * 4 / 5).cast("long"))
    )
    asked = opened(anchors.join(requests, "key"), False)
    other = dealt(asked, look_other, "key string, positive_score long, score long, vec_id long")
    return (
        paired.join(first(other, ["key", "positive_score"], negatives), ["key", "positive_score"])
        .select("anchor_id", "positive_id", "positive_score", F.explode("best").alias("b"))
        .select(
            "anchor_id", "positive_id", F.col("b.at").cast("int").alias("rank"),
            F.col("b.vec_id").alias("negative_id"), "positive_score", F.col("b.score").alias("negative_score"),
        )
    )
