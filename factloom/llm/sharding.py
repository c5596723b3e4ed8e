"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all documents of one text.  Groups sorted by size enter the bin with the
tightest remaining capacity that still holds them; a balanced tree of remaining
capacities finds it.

One machine must not see all groups, so packing has two levels with the same rule.
With ``unit`` = total / (shards * PARCELS), a group larger than ``unit`` is an item of
its own (there are fewer than shards * PARCELS); smaller ones are packed per partition
into parcels of capacity ``unit``.  Two parcels of one partition always exceed a unit
together, so items number at most 3 * shards * PARCELS + partitions.  They are packed
into the shards.  Shard sizes then differ by about one parcel in the worst case.

Null text counts as the empty text.  A null doc_id is kept.  Repeated rows are rows of
the same group.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, numbered, pinned, text_or_empty, with_code

#: Parcels that make up one shard.
PARCELS = 64


class Capacities:
    """A balanced search tree (two levels, blocks split when full) of (remaining, bin)."""

    BLOCK = 256

    def __init__(self) -> None:
        self.blocks: list[list[tuple[int, int]]] = []
        self.highest: list[tuple[int, int]] = []

    def add(self, item: tuple[int, int]) -> None:
        if not self.blocks:
            self.blocks, self.highest = [[item]], [item]
            return
        at = min(bisect_left(self.highest, item), len(self.blocks) - 1)
        block = self.blocks[at]
        insort(block, item)
        self.highest[at] = block[-1]
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks[at : at + 1] = [block[:half], block[half:]]
            self.highest[at : at + 1] = [block[half - 1], block[-1]]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest remaining capacity that holds ``size``."""
        at = bisect_left(self.highest, (size, -1))
        if at == len(self.blocks):
            return None
        block = self.blocks[at]
        item = block.pop(bisect_left(block, (size, -1)))
        if block:
            self.highest[at] = block[-1]
        else:
            del self.blocks[at], self.highest[at]
        return item


class BestFit:
    """Open bins of one capacity; a larger item gets a bin of its own."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.bins, self.open = capacity, 0, Capacities()

    def place(self, size: int) -> int:
        found = self.open.take_tightest(size)
        if found is None:
            found, self.bins = (self.capacity, self.bins), self.bins + 1
        remaining, number = found
        if remaining > size:
            self.open.add((remaining - size, number))
        return number


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> list[int]:
    """The bin of each size; ``sizes`` come in decreasing order."""
    bins = BestFit(capacity)
    return [bins.place(int(size)) for size in sizes]


def into_bins(sizes: list[int], bins: int) -> list[int]:
    """Place decreasing ``sizes`` into ``bins`` bins of nearly equal load.

    An item at least as large as an equal share of what is left gets a bin of its own.
    For the others, the smallest capacity is searched at which best fit needs no more
    bins than there are.
    """
    alone, left = 0, sum(sizes)
    while alone < len(sizes) and bins - alone > 1 and sizes[alone] * (bins - alone) >= left:
        left -= sizes[alone]
        alone += 1
    rest, free = sizes[alone:], bins - alone
    if not rest:
        return list(range(alone))
    low, high = max(rest[0], -(-left // free)), max(rest[0], -(-left // free)) + rest[0]
    while low < high:
        middle = (low + high) // 2
        if max(best_fit_decreasing(rest, middle)) < free:
            high = middle
        else:
            low = middle + 1
    placed = levelled(rest, best_fit_decreasing(rest, low), free)
    return [*range(alone), *(alone + number for number in placed)]


def levelled(sizes: list[int], placed: list[int], bins: int, steps: int = 1000) -> list[int]:
    """Best fit leaves the last bins short; move single items from the fullest to the emptiest."""
    loads, members = [0] * bins, [[] for _ in range(bins)]
    for at, (size, number) in enumerate(zip(sizes, placed)):
        loads[number] += size
        insort(members[number], (size, at))
    placed = list(placed)
    for _ in range(steps):
        most, least = loads.index(max(loads)), loads.index(min(loads))
        gap = loads[most] - loads[least]
        # The item nearest to half the gap narrows it most; any below the gap narrows it.
        near = bisect_left(members[most], (gap // 2, -1))
        found = [item for item in members[most][max(0, near - 1) : near + 1] if item[0] < gap]
        if not found:
            break
        size, at = min(found, key=lambda item: abs(2 * item[0] - gap))
        members[most].remove((size, at))
        insort(members[least], (size, at))
        loads[most] -= size
        loads[least] += size
        placed[at] = least
    return placed


def parcels(groups: DataFrame, unit: int) -> DataFrame:
    """Add the parcel of each group (``bytes`` <= unit), packed partition by partition."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, first = BestFit(unit), TaskContext.get().partitionId() << 32
        for batch in batches:
            at = np.array([bins.place(int(size)) for size in batch["bytes"]], dtype="int64")
            yield batch.assign(parcel=at + first)

    ordered = groups.sortWithinPartitions(F.desc("bytes"), "key")
    return ordered.mapInPandas(pack, "key binary, rows long, bytes long, parcel long")


def fixed_capacity(documents: DataFrame, capacity: int) -> DataFrame:
    """(key, rows, bytes, bin): groups in few bins of ``capacity`` bytes.

    Bins do not span partitions, so there may be one underfull bin per partition more.
    """
    groups = _groups(_rows(documents))
    return parcels(groups, capacity).withColumnRenamed("parcel", "bin")


def _rows(documents: DataFrame) -> DataFrame:
    """One narrow row per document; the text stays behind."""
    text = text_or_empty()
    return documents.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")
    )


def into_shards(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Every document with its shard and its place there, shard sizes in bytes near equal.

    Columns: doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    spark = with_code(documents.sparkSession)
    rows = pinned(_rows(documents))
    groups = pinned(_groups(rows))
    total, documents_in = groups.agg(F.sum("bytes"), F.sum("rows")).first()
    unit = max(1, -(-(total or 0) // (shards * PARCELS)))
    packed = pinned(parcels(groups.filter(F.col("bytes") <= unit), unit))
    # Both lists are bounded, see the head of this file.
    large = groups.filter(F.col("bytes") > unit).select("key", "bytes").collect()
    loads = packed.groupBy("parcel").agg(F.sum("bytes").alias("bytes")).collect()
    items = sorted(
        [(row["bytes"], bytes(row["key"]), None) for row in large]
        + [(row["bytes"], b"", row["parcel"]) for row in loads],
        key=lambda item: (-item[0], item[1], item[2] or 0),
    )
    shard_of = into_bins([item[0] for item in items], shards) if items else []
    by_key = [(key, shard) for (_, key, parcel), shard in zip(items, shard_of) if parcel is None]
    by_parcel = [(parcel, shard) for (_, _, parcel), shard in zip(items, shard_of) if parcel is not None]
    placed = (
        packed.join(F.broadcast(spark.createDataFrame(by_parcel, "parcel long, shard int")), "parcel")
        .select("key", "rows", "shard")
        .unionByName(
            groups.join(F.broadcast(spark.createDataFrame(by_key, "key binary, shard int")), "key")
            .select("key", "rows", "shard")
        )
    )
    sharded = attach(rows, placed, "key", "rows", documents_in or 0)
    slots = numbered(sharded, ["shard"], ["doc_id", "key"], "slot", documents_in or 0)
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
