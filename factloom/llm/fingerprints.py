"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is cut into short paragraphs: lines, in them sentences, and long sentences at word
ends.  Their digests (a repeated paragraph gets a new digest each time) go into cells of
(count, xor of digests, xor of check values), each digest into one cell of each of three
tables.  Subtracting the sketches of two versions cancels what they share; peeling cells
that hold one digest gives back the digests that differ.  If peeling gets stuck, both
sketches are made again four times as large, until it ends.

The fingerprint is the smallest sketch, as text.  The likeness of two texts is the share
of digests they have in common among all they have, read off the recovered differences;
two texts without paragraphs are alike.

Null text counts as the empty text.  Rows are in order of descending id, null ids last;
rows of one id are in order of a hash of their text.  A document that is alone is its own
next one.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned, text_or_empty, with_code

#: Cells of each of the three tables of a fingerprint, and growth when peeling fails.
CELLS, GROWTH = 8, 4
#: Attempts before differences are taken from the digests themselves.
ATTEMPTS = 16
#: Ranges of ids per shuffle partition.
RANGES = 4
#: Characters that are compared at a time.
AT_ONCE = 2_000_000

_PARAGRAPH = re.compile(r"(?:[^\n.!?]{1,48}[^\s.!?]*|[.!?\n])[.!?\s]*")
_TABLES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_CHECK = np.uint64(0xD6E8FEB86659FD93)


def mixed(values: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers, without losing any."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def digests(text: str) -> np.ndarray:
    """One digest per paragraph; the n-th copy of a paragraph has its own."""
    hashed = [xxhash.xxh64_intdigest(part.encode("utf-8")) for part in _PARAGRAPH.findall(text)]
    found = np.array(hashed, dtype=np.uint64)
    values, first, many = np.unique(found, return_index=True, return_counts=True)
    if len(values) < len(found):
        order = np.argsort(found, kind="stable")
        starts = np.repeat(np.cumsum(many) - many, many)
        copy = np.empty(len(found), dtype=np.uint64)
        copy[order] = (np.arange(len(found)) - starts).astype(np.uint64)
        found = np.where(copy > 0, mixed(found ^ mixed(copy)), found)
    return found


class Sketches:
    """Sketches of many texts at once, with ``cells`` cells in each of three tables."""

    def __init__(self, sets: list[np.ndarray], cells: int) -> None:
        self.texts, self.cells = len(sets), cells
        owner = np.repeat(np.arange(len(sets)), [len(found) for found in sets])
        values = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
        self.count = np.zeros(self.texts * 3 * cells, dtype=np.int64)
        self.key = np.zeros(len(self.count), dtype=np.uint64)
        self.check = np.zeros(len(self.count), dtype=np.uint64)
        self._add(owner, values, 1)

    def _places(self, owner: np.ndarray, values: np.ndarray) -> np.ndarray:
        spread = mixed(values[:, None] ^ _TABLES) % np.uint64(self.cells)
        return (owner[:, None] * 3 + np.arange(3)) * self.cells + spread.astype(np.int64)

    def _add(self, owner: np.ndarray, values: np.ndarray, sign: np.ndarray | int) -> None:
        places = self._places(owner, values).ravel()
        each = np.repeat(values, 3)
        order = np.argsort(places, kind="stable")
        places, each = places[order], each[order]
        signs = np.repeat(np.broadcast_to(sign, len(values)), 3)[order]
        at = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]) if len(places) else np.zeros(0, int)
        if len(at):
            cell = places[at]
            self.count[cell] += np.add.reduceat(signs, at)
            self.key[cell] ^= np.bitwise_xor.reduceat(each, at)
            self.check[cell] ^= np.bitwise_xor.reduceat(mixed(each ^ _CHECK), at)

    def minus(self, other: Sketches) -> Sketches:
        result = Sketches([], self.cells)
        result.texts = self.texts
        result.count = self.count - other.count
        result.key, result.check = self.key ^ other.key, self.check ^ other.check
        return result

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(done, here, there, owner, digest): per text whether all was recovered and how many
        digests only one side has; then the recovered digests with their text."""
        here, there = np.zeros(self.texts, dtype=np.int64), np.zeros(self.texts, dtype=np.int64)
        owners, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        look = np.arange(len(self.count))
        while len(look):
            single = look[np.abs(self.count[look]) == 1]
            single = single[self.check[single] == mixed(self.key[single] ^ _CHECK)]
            owner = single // (3 * self.cells)
            pairs = np.stack([owner.astype(np.uint64), self.key[single]], axis=1)
            _, first = np.unique(pairs, axis=0, return_index=True) if len(single) else (None, [])
            single, owner = single[first], owner[first]
            values, sign = self.key[single], self.count[single]
            here += np.bincount(owner[sign > 0], minlength=self.texts)
            there += np.bincount(owner[sign < 0], minlength=self.texts)
            owners.append(owner)
            found.append(values)
            look = np.unique(self._places(owner, values)) if len(single) else np.zeros(0, int)
            self._add(owner, values, -sign)
        left = (self.count != 0) | (self.key != 0)
        done = ~left.reshape(self.texts, 3 * self.cells).any(axis=1)
        return done, here, there, np.concatenate(owners), np.concatenate(found)

    def as_text(self) -> list[str]:
        """Each sketch as base64 of its counts, digests and check values."""
        rows = 3 * self.cells
        parts = (self.count.astype("<u4"), self.key.astype("<u8"), self.check.astype("<u8").view("<u4")[::2])
        raw = [np.ascontiguousarray(part).reshape(self.texts, rows) for part in parts]
        return [
            base64.b64encode(b"".join(part[at].tobytes() for part in raw)).decode("ascii")
            for at in range(self.texts)
        ]


def likeness(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """For each pair of digest sets, their common share, by sketches that grow until they peel."""
    result = np.zeros(len(left))
    open_, attempt = np.arange(len(left)), 0
    while len(open_):
        ours, theirs = [left[at] for at in open_], [right[at] for at in open_]
        if attempt < ATTEMPTS:
            done, here, there, _, _ = Sketches(ours, cells).minus(Sketches(theirs, cells)).peel()
        else:
            here = np.array([len(np.setdiff1d(a, b)) for a, b in zip(ours, theirs)])
            there = np.array([len(np.setdiff1d(b, a)) for a, b in zip(ours, theirs)])
            done = np.ones(len(open_), dtype=bool)
        common = np.array([len(a) for a in ours]) - here
        every = np.maximum(1, common + here + there)
        share = np.where(common + here + there == 0, 1.0, common / every)
        result[open_[done]] = share[done]
        open_, cells, attempt = open_[~done], cells * GROWTH, attempt + 1
    return result


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the start of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _compared(rows: list[tuple]) -> pd.DataFrame:
    """Result rows of (doc_id, text, digests, next text, next digests)."""
    changed = [edited(row[1], row[3]) for row in rows]
    own, later = [row[2] for row in rows], [row[4] for row in rows]
    new = [digests(text) for text in changed]
    return pd.DataFrame(
        {
            "doc_id": [row[0] for row in rows],
            "n_chars": [len(row[1]) for row in rows],
            "edited_sha256": [hashlib.sha256(text.encode("utf-8")).hexdigest() for text in changed],
            "fingerprint": Sketches(own, CELLS).as_text(),
            "edited_fingerprint": Sketches(new, CELLS).as_text(),
            "near_edited": likeness(own, new),
            "near_next": likeness(own, later),
        }
    )


def with_neighbours(documents: DataFrame) -> DataFrame:
    """(part, guest, doc_id, text): documents dealt by ranges of ids, largest ids first.

    Each range is one ``part``, in order; behind it, as a guest, stands the document that
    the next range starts with, and behind the last range the first of all.  Only the
    bounds of the ranges reach the driver, a few for each shuffle partition.
    """
    spark = with_code(documents.sparkSession)
    rows = documents.select("doc_id", text_or_empty().alias("text"))
    narrow = pinned(rows.select("doc_id", F.xxhash64("text").alias("tie")))
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [at / ranges for at in range(1, ranges)]
    bounds = narrow.agg(F.percentile_approx("doc_id", shares, 10 * ranges)).first()[0] or []
    bounds = np.unique(np.array(bounds, dtype=np.int64))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        at = len(bounds) - np.searchsorted(bounds, ids.fillna(0).to_numpy().astype(np.int64))
        return pd.Series(np.where(ids.isna(), len(bounds) + 1, at))

    first = F.struct(F.col("doc_id").isNotNull(), "doc_id", -F.col("tie").cast("decimal(20,0)"))
    heads = sorted(
        narrow.withColumn("part", part_of("doc_id").cast("int"))
        .groupBy("part")
        .agg(F.max_by(F.struct("doc_id", "tie"), first).alias("head"))
        .collect()
    )
    guests = [
        (row["head"]["doc_id"], row["head"]["tie"], heads[at - 1]["part"]) for at, row in enumerate(heads)
    ]
    kind = documents.schema["doc_id"].dataType.simpleString()
    listed = F.broadcast(spark.createDataFrame(guests, f"_id {kind}, _tie long, host int"))
    return (
        rows.withColumn("tie", F.xxhash64("text"))
        .withColumn("part", part_of("doc_id"))
        .join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
        .withColumn(
            "seat",
            F.explode(
                F.array_compact(
                    F.array(
                        F.struct("part", F.lit(False).alias("guest")),
                        F.when(
                            F.col("host").isNotNull(),
                            F.struct(F.col("host").alias("part"), F.lit(True).alias("guest")),
                        ),
                    )
                )
            ),
        )
        .select("seat.part", "seat.guest", "doc_id", "tie", "text")
        .repartition("part")
        .sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "tie")
        .drop("tie")
    )


def fingerprinted(documents: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, rows, held = None, [], 0
        for batch in batches:
            for part, guest, doc_id, text in batch.itertuples(index=False, name=None):
                if before is not None and before[0] == part and before[1]:
                    continue  # one guest is enough
                now = (part, guest, doc_id, text, digests(text))
                if before is not None and before[0] == part:
                    rows.append((before[2], before[3], before[4], text, now[4]))
                    held += len(before[3])
                before = now
                if held > AT_ONCE:
                    yield _compared(rows)
                    rows, held = [], 0
        if rows:
            yield _compared(rows)

    kind = documents.schema["doc_id"].dataType.simpleString()
    seated = with_neighbours(documents).select(
        "part", "guest", F.col("doc_id").cast("string").alias("doc_id"), "text"
    )
    return seated.mapInPandas(
        compare,
        "doc_id string, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    ).withColumn("doc_id", F.col("doc_id").cast(kind))
