"""Near-duplicates by exact likeness of shingle sets, met through SimHash, the rest through MinHash bands.

Two texts link if the sets of their five-word shingles have a Jaccard likeness of 0.8 or
more; documents that are connected by links form a component.  Equal sets are one node.

1. The SimHash of each set goes through the index in Gray order of :mod:`simhash`.  Each node
   is compared with the nearest that it links within :data:`RADIUS` bits, by their whole sets.
2. Not all links are that near in bits (28 % at a likeness of 0.8 to 0.85, 90 % from 0.95).
   For the rest, each node has :data:`BANDS` keys, each of :data:`ROWS` minima of hashes.
   Linked nodes share a key but for a chance of (1 - 0.8**4)**20, 3 in 100,000.
3. The nodes of a bucket are compared with its smallest node, by their whole sets.
4. Buckets with nodes of several components are searched pair by pair in place, leaving
   out what is connected already; a bucket hands on one edge per node at most.

Null text counts as the empty text.  Texts without words have an empty set and link each
other; texts of fewer than five words are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, pinned, text_or_empty, with_code
from .simhash import components, links, majority, roots

WORDS, LIKENESS = 5, 0.8
#: Bits in which fingerprints differ at most that the index links.
RADIUS = 6
BANDS, ROWS = 20, 4
#: Shingles that are hashed at a time.
AT_ONCE = 4096

_CHANCE = np.random.default_rng(42)
FACTORS = _CHANCE.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDED = _CHANCE.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the shingles of a whole text, in order."""
    words = text.encode("utf-8").lower().split()
    wide = min(WORDS, len(words))
    found = {xxhash.xxh64_intdigest(b" ".join(words[at : at + wide])) for at in range(len(words) - wide + 1) if wide}
    return np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed key per band; that of an empty set is of its own."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), AT_ONCE):
        mixed = hashes[at : at + AT_ONCE, None] * FACTORS + ADDED
        # The upper bits depend on all bits below them, so they order the products.
        np.minimum(least, mixed.min(axis=0), out=least)
    raw = least.astype("<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), at) - 2**63 for at, row in enumerate(raw)]


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes()) - 2**63


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def linked(sets: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Component labels of sets, given those that are known: all pairs that are apart are compared."""
    sizes = np.array([len(one) for one in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    starts = np.r_[0, np.cumsum(sizes)]
    held = np.zeros(int(ids.max(initial=-1)) + 1, dtype=bool)
    for at in range(len(sets)):
        apart = label != label[at]
        apart[: at + 1] = False
        if not apart.any():
            continue
        own = ids[starts[at] : starts[at + 1]]
        held[own] = True
        both = np.bincount(owner[starts[at + 1] :][held[ids[starts[at + 1] :]]], minlength=len(sets))
        held[own] = False
        near = np.flatnonzero(apart & (both >= LIKENESS * (sizes + sizes[at] - both) - 1e-9))
        label = components(len(sets), np.full(len(near), at), near, label)
    return label


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by key, cut and put together to one frame per key."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for key, group in batch.groupby("key", sort=False):
            if held and held[0]["key"].iloc[0] != key:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(group)
    if held:
        yield pd.concat(held, ignore_index=True)


def nodes_of(documents: DataFrame) -> DataFrame:
    """doc_id, said (hash of the text), node, fp (SimHash of the set), keys."""
    with_code(documents.sparkSession)

    @F.pandas_udf("node long, fp long, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(text) for text in texts]
        bits = np.array([majority(one) for one in sets], dtype=np.uint64).view(np.int64)
        return pd.DataFrame({"node": [node_of(one) for one in sets], "fp": bits, "keys": [band_keys(one) for one in sets]})

    text = text_or_empty()
    return documents.select("doc_id", F.xxhash64(text).alias("said"), of(text).alias("out")).select(
        "doc_id", "said", "out.*"
    )


def sets_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, hashes of the nodes of ``wanted`` (node, said, rows): texts are read again for these only."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: shingles(text).tobytes())

    total = wanted.agg(F.sum("rows")).first()[0] or 0
    texts = documents.select(text_or_empty().alias("text")).withColumn("said", F.xxhash64("text"))
    first = attach(texts, wanted, "said", "rows", total).dropDuplicates(["said"])
    return first.select("node", of("text").alias("hashes"))


def edges(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links between nodes that connect what all links connect.  ``nodes``: node, said, fp, keys, rows."""
    near = pinned(links(nodes, RADIUS))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    groups = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("members"))
    groups = pinned(groups.filter(F.col("members") > 1))
    total = groups.agg(F.sum("members")).first()[0] or 0
    shared = pinned(attach(keyed, groups, "key", "members", total).select("key", "node", "least"))
    compared = shared.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node")))
    wanted = nodes.join(compared.distinct(), "node", "left_semi").select("node", "said", "rows")
    wanted = pinned(wanted)
    sets = pinned(sets_of(documents, wanted))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = zip(a, b)
        return pd.Series([likeness(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs], dtype=float)

    stars = shared.filter(F.col("node") != F.col("least")).select(F.col("node").alias("a"), F.col("least").alias("b"))
    pairs = pinned(near.unionByName(stars).distinct())
    often = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("times"))
    right = often.join(sets.withColumnRenamed("node", "b"), "b").withColumnRenamed("hashes", "other")
    both = attach(pairs, right, "b", "times", pairs.count()).join(sets.withColumnRenamed("node", "a"), "a")
    sure = pinned(both.filter(alike("hashes", "other") >= LIKENESS - 1e-12).select("a", "b"))

    known = roots(sure).withColumnRenamed("fp", "node")
    placed = pinned(shared.join(known, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"))
    open_ = pinned(several.filter("low != high").select("key", "members"))
    left = attach(placed, open_, "key", "members", total).join(sets, "node")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _buckets(batches):
            names = group["node"].to_numpy()
            _, first, of = np.unique(group["root"].to_numpy(), return_index=True, return_inverse=True)
            before = first[of]
            label = linked([np.frombuffer(one, np.uint64) for one in group["hashes"]], before.copy())
            # A known component is linked elsewhere, so its first node moves for all of it.
            moved = np.flatnonzero(label != before)
            yield pd.DataFrame({"a": names[moved], "b": names[label[moved]]})

    more = left.select("key", "node", "root", "hashes").repartition("key").sortWithinPartitions("key")
    return sure.unionByName(more.mapInPandas(search, "a long, b long").distinct())


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, said (hash of the text) and component of every row."""
    found = pinned(nodes_of(documents))
    nodes = pinned(found.groupBy("node").agg(F.min("said").alias("said"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("rows")))
    rooted = nodes.join(roots(edges(documents, nodes)).withColumnRenamed("fp", "node"), "node", "left")
    named = rooted.select("node", F.coalesce("root", "node").alias("component"), "rows")
    total = nodes.agg(F.sum("rows")).first()[0] or 0
    return attach(found.select("doc_id", "said", "node"), named, "node", "rows", total).select("doc_id", "said", "component")
