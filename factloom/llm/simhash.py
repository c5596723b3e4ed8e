"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints of 64 bits come from hashed word shingles.  Two link if they differ in at
most ``radius`` bits; documents that are connected by links form a component.

All links are found, and none is written out twice or as a pair within a group:

1. Equal fingerprints are one node, so copies cost nothing more.
2. Two blocks of bits more than the radius: linked nodes have two equal blocks.  Each node
   goes to one bucket for each pair of blocks; linked nodes meet in a bucket.  Buckets
   above :data:`BUCKET` nodes are dealt again by equal parts of their other bits.
3. In a bucket, nodes are sorted by Gray rank, so neighbours differ in few bits.  Groups
   of neighbours share a mask of bits on which they agree and the pattern there; groups of
   groups take over what their members share.  A search adds up differences on the way
   down, counting each bit at the highest place that has it, and leaves out a group as soon
   as the sum exceeds the radius, or when the group is in the component already.
4. A bucket hands on one edge per node at most (to the smallest of its component there).
   Components over buckets are found by star contraction on tables.  For links that have
   yet to be confirmed, each node gets the nearest of those that joined its buckets (:func:`links`).

Null text counts as the empty text.  Texts without words have fingerprint zero and link
like any other.  Null ids are never the smallest id of a component unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, pinned, text_or_empty, unused, with_code

WORDS, SEED, RADIUS = 4, 42, 4
#: Nodes that one bucket should hold at most.
BUCKET = 500_000
#: Members of a group of the index, and queries that search together.
FAN, TOGETHER = 8, 4096
#: Rows that a task puts in order at a time, if not one bucket has more.
AT_ONCE = 400_000


def majority(hashed: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as an unsigned number."""
    bits = np.unpackbits(hashed.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    often = np.add.reduce(bits, axis=0, dtype=np.int64) * 2 > len(hashed)
    return int(np.packbits(often, bitorder="little").view("<u8")[0])


def fingerprint(text: str) -> int:
    """The SimHash of a whole text, as an unsigned number."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = (ends - [len(word) for word in words]).tolist()
    wide = min(WORDS, len(words))
    digest = xxhash.xxh64_intdigest
    return majority(
        np.array([digest(data[a:b], SEED) for a, b in zip(starts, ends[wide - 1 :].tolist())], dtype="<u8")
    )


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""
    with_code(documents.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(text) for text in texts], dtype=np.uint64).view(np.int64))

    return documents.select("doc_id", of(text_or_empty()).alias("fp"))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each value in the Gray sequence."""
    values = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        values ^= values >> np.uint64(shift)
    return values


def components(
    size: int, left: np.ndarray, right: np.ndarray, label: np.ndarray, used: list[np.ndarray] | None = None
) -> np.ndarray:
    """The smallest member of each one's component, given earlier labels and more links.

    Links that joined two components are added to ``used``: one less than a component has members.
    """
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        high, low = np.maximum(a, b), np.minimum(a, b)
        if used is not None and len(left):
            order = np.lexsort((low, high))
            first = order[np.r_[True, np.diff(high[order]) > 0]]
            used.append(np.stack([left[first], right[first]]))
        np.minimum.at(label, high, low)
        while True:
            next_label = label[label]
            if np.array_equal(next_label, label):
                break
            label = next_label
    return label


class GrayIndex:
    """Groups of groups over values in Gray order; see the head of this file."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        ones = np.full(len(values), ~np.uint64(0))
        self.levels = [(ones, values)]
        while len(self.levels[-1][0]) > FAN:
            mask, pattern = self.levels[-1]
            at = np.arange(0, len(mask), FAN)
            every = np.bitwise_and.reduceat(pattern, at)
            some = np.bitwise_or.reduceat(pattern, at)
            shared = np.bitwise_and.reduceat(mask, at) & ~(every ^ some)
            self.levels.append((shared, every & shared))

    def links(self, first: int, last: int, label: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Links of the values first..last with later ones that are not in their component."""
        low, high = [label], [label]
        for _ in self.levels[1:]:
            at = np.arange(0, len(low[-1]), FAN)
            low.append(np.minimum.reduceat(low[-1], at))
            high.append(np.maximum.reduceat(high[-1], at))
        top = len(self.levels) - 1
        queries = np.arange(first, last)
        query = np.repeat(queries, len(self.levels[top][0]))
        node = np.tile(np.arange(len(self.levels[top][0])), len(queries))
        differences = np.zeros(len(query), dtype=np.int64)
        above = np.zeros(len(query), dtype=np.uint64)
        for level in range(top, -1, -1):
            mask, pattern = self.levels[level]
            own = mask[node] & ~above
            differences = differences + np.bitwise_count((self.values[query] ^ pattern[node]) & own)
            keep = differences <= radius
            keep &= (node + 1) * FAN**level > query + 1
            keep &= ~((low[level][node] == high[level][node]) & (low[level][node] == label[query]))
            query, node, differences = query[keep], node[keep], differences[keep]
            if level:
                above = np.repeat(mask[node], FAN)
                query, differences = np.repeat(query, FAN), np.repeat(differences, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < len(self.levels[level - 1][0])
                query, node, differences, above = query[there], node[there], differences[there], above[there]
        return query, node


def linked(values: np.ndarray, radius: int, used: list[np.ndarray] | None = None) -> np.ndarray:
    """Component labels of distinct values in Gray order; ``used`` as in :func:`components`."""
    label = np.arange(len(values))
    for step in range(1, min(FAN, len(values))):
        near = np.flatnonzero(np.bitwise_count(values[:-step] ^ values[step:]) <= radius)
        label = components(len(values), near, near + step, label, used)
    if len(values) > FAN:
        index = GrayIndex(values)
        for first in range(0, len(values), TOGETHER):
            found = index.links(first, min(first + TOGETHER, len(values)), label, radius)
            label = components(len(values), *found, label, used)
    return label


def _labelled(
    keys: np.ndarray, values: np.ndarray, radius: int, used: list[np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by bucket, and for each the first place of its component in its bucket."""
    order = np.lexsort((gray_rank(values), keys))
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    # Buckets that are one group of the index: all of them at once, neighbour by neighbour.
    small = np.repeat(sizes <= FAN, sizes)
    label = np.arange(len(values))
    for step in range(1, min(FAN, len(values))):
        near = (
            small[:-step] & (keys[:-step] == keys[step:])
            & (np.bitwise_count(values[:-step] ^ values[step:]) <= radius)
        )
        at = np.flatnonzero(near)
        label = components(len(values), at, at + step, label, used)
    for start, size in zip(starts[sizes > FAN], sizes[sizes > FAN]):
        inside = None if used is None else []
        label[start : start + size] = start + linked(values[start : start + size], radius, inside)
        if inside:
            used.extend(start + pair for pair in inside)
    return order, label


def bucket_edges(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, smallest value of its component) of all buckets."""
    order, label = _labelled(keys, values, radius)
    values = values[order]
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def bucket_links(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that joined the components of all buckets."""
    used = [np.zeros((2, 0), dtype=np.int64)]
    order, _ = _labelled(keys, values, radius, used)
    left, right = np.concatenate(used, axis=1)
    return order[left], order[right]


def _part(value: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << bits) - 1))


def blocks(radius: int) -> list[tuple[int, int]]:
    """First bit and number of bits of the blocks: two more than the radius, of nearly equal size."""
    whole, more = divmod(64, radius + 2)
    return [(at * whole + min(at, more), whole + (at < more)) for at in range(radius + 2)]


def bucketed(nodes: DataFrame, radius: int, limit: int = BUCKET) -> DataFrame:
    """The buckets (key) of each node (fp and what else it has); nodes within the radius share one of them."""
    pairs = [
        F.xxhash64(F.lit(at), _part(F.col("fp"), *a), _part(F.col("fp"), *b))
        for at, (a, b) in enumerate(combinations(blocks(radius), 2))
    ]
    keyed = nodes.select(F.explode(F.array(*pairs)).alias("key"), *nodes.columns)
    large = pinned(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("key"))
    if large.isEmpty():
        return keyed
    # Inside such a bucket, at most ``radius`` of radius + 1 parts of the word differ.
    edges = [64 * at // (radius + 1) for at in range(radius + 2)]
    parts = [
        F.xxhash64(F.col("key"), F.lit(at), _part(F.col("fp"), a, b - a))
        for at, (a, b) in enumerate(zip(edges, edges[1:]))
    ]
    again = keyed.join(large, "key", "left_semi").select(F.explode(F.array(*parts)).alias("key"), *nodes.columns)
    return keyed.join(large, "key", "left_anti").unionByName(again)


def edges(nodes: DataFrame, radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """(a, b): edges between distinct fingerprints that connect what links connect."""
    with_code(nodes.sparkSession)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _grouped(batches):
            a, b = bucket_edges(
                batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64), radius
            )
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    keyed = bucketed(nodes.select("fp"), radius, limit).repartition("key").sortWithinPartitions("key")
    return keyed.mapInPandas(search, "a long, b long").distinct()


def links(nodes: DataFrame, radius: int, limit: int = BUCKET) -> DataFrame:
    """(a, b): for each node that has links, the nearest in bits of those that joined its buckets.

    ``nodes``: fp, node (the name); several nodes may have one fingerprint.
    """
    with_code(nodes.sparkSession)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _grouped(batches):
            values, names = batch["fp"].to_numpy().view(np.uint64), batch["node"].to_numpy()
            a, b = bucket_links(batch["key"].to_numpy(), values, radius)
            a, b = np.r_[a, b], np.r_[b, a]
            bits = np.bitwise_count(values[a] ^ values[b]).astype(np.int32)
            yield pd.DataFrame({"a": names[a], "bits": bits, "b": names[b]})

    keyed = bucketed(nodes.select("fp", "node"), radius, limit).repartition("key").sortWithinPartitions("key")
    found = keyed.mapInPandas(search, "a long, bits int, b long")
    return found.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("near")).select("a", "near.b")


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by key, put together so that no key is in two of them."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows >= AT_ONCE:
            whole = pd.concat(held, ignore_index=True)
            keys = whole["key"].to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if cut:
                yield whole.iloc[:cut]
            held = [whole.iloc[cut:]]
            rows = len(held[0])
    if rows:
        yield pd.concat(held, ignore_index=True)


def roots(found: DataFrame) -> DataFrame:
    """(fp, root) of every node with an edge, but for the roots: the smallest node connected.

    Star contraction: each node hands its larger neighbours, then its smaller ones, to its
    smallest neighbour.  Each round is pinned, so lineage stays short and survives losses.
    """
    stars = pinned(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        larger = (
            both.join(least, "a").filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        )
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*").filter("a != b").distinct()
        stars = pinned(smaller)
        seen = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if seen == state:
            return stars.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        state = seen


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id of every document."""
    found = pinned(fingerprints(documents))
    nodes = pinned(
        found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    )
    number, rows = nodes.agg(F.count(F.lit(1)), F.sum("rows")).first()
    rooted = nodes.join(roots(edges(nodes, radius)), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    groups = rooted.groupBy("root").agg(
        F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members")
    )
    named = attach(rooted, groups, "root", "members", number or 0).select("fp", "component_id", "rows")
    return attach(found, named, "fp", "rows", rows or 0).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with its columns.

    Components are those of :mod:`minhash`: fingerprints of five words, found by the index of
    this module, likeness 0.8; four words and four bits hold for :func:`near_duplicates` only.
    Rows are told apart by id and text: of rows with one id, each text is judged by itself,
    and rows that repeat both are one document.  Documents without an id link others but are
    all kept, since nothing tells them apart.
    """
    from .minhash import near_duplicates as alike

    least = F.min(F.struct("doc_id", "said")).alias("least")
    first = alike(documents).filter("doc_id IS NOT NULL").groupBy("component").agg(least)
    at, said = unused(documents, "_at"), unused(documents, "_said")
    first = first.select("least.doc_id", F.col("least.said").alias(said))
    once = Window.partitionBy("doc_id", said).orderBy(F.lit(0))
    kept = (
        documents.withColumn(said, F.xxhash64(text_or_empty()))
        .join(first, ["doc_id", said], "left_semi")
        .withColumn(at, F.row_number().over(once))
        .filter(F.col(at) == 1)
        .select(*documents.columns)
    )
    return kept.unionByName(documents.filter(F.col("doc_id").isNull()))
