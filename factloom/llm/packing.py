"""Best-fit packing of token sequences by a configuration linear program.

Documents become ids and an end id.  A document of more than ``capacity`` ids is cut into
pieces of ``capacity``, of which the first may be shorter.  Only the histogram of piece
lengths (``capacity`` numbers at most) reaches the driver.  There a configuration is a
multiset of lengths that fits one sequence, and the program asks for the fewest
configurations that use up the histogram.  It is solved by multiplicative weights: each
length has a price, a knapsack dynamic program finds the dearest configuration, and
prices of lengths that are covered fall.  Multiplicities are rounded down, and
the rest goes by best fit decreasing, on the histogram too, into the gaps and new sequences.

The plan is a bounded list of (configuration, how often).  Pieces are numbered within
their length in parallel and look up sequence and offset by that number.

Null text counts as the empty text, which is the end id alone.  Repeated rows are packed
each.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, pinned, text_or_empty, with_code

#: Pricings, how fast prices fall, configurations per pricing, and the part of a length
#: that one use of a configuration covers.
UPDATES, STEP, AROUND, PART = 400, 0.1, 32, 0.1
#: How much more than in proportion long pieces are worth; the program is solved with each.
TILTS = (0.0, 0.5)
#: Share of lengths that may not be covered more than once by the rounded solution.
EVEN = 0.9

# --- fixed values: how byte-level BPE cuts texts before merging, and writes bytes as letters
PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
#: The white space of the pattern, and how much of it in a row is cut out before matching:
#: a run is held on a stack of bounded size until it is clear what follows it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG_RUN = 100_000
PLAIN_BYTES = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
# ---------------------------------------------------------------------------------------------


@cache
def byte_bpe(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file; ids are equal to those of that library.

    Merging is in the order of ids in such files, so the vocabulary gives the ranks.
    """
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    others = [byte for byte in range(256) if byte not in PLAIN_BYTES]
    byte_of = {chr(byte): byte for byte in PLAIN_BYTES} | {chr(256 + at): byte for at, byte in enumerate(others)}
    special = {token["content"]: token["id"] for token in stored["added_tokens"] if token["special"]}
    ranks = {
        bytes(byte_of[letter] for letter in name): number
        for name, number in stored["model"]["vocab"].items()
        if name not in special
    }
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


_GAP = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")


def token_ids(text: str, path: str) -> list[int]:
    """All ids; of a long run of white space, all but the last character are merged by themselves.

    The last one belongs to what follows it, unless that is a special string or nothing.
    """
    bpe = byte_bpe(path)
    if len(text) < LONG_RUN:
        return bpe.encode(text, allowed_special="all")
    ids, done = [], 0
    for gap in _GAP.finditer(text):
        start, end = gap.span()
        alone = end == len(text) or any(text.startswith(name, end) for name in bpe.special_tokens_set)
        ids += bpe.encode(text[done:start], allowed_special="all")
        done = end if alone else end - 1
        ids += bpe._encode_single_piece(text[start:done])
    return ids + bpe.encode(text[done:], allowed_special="all")


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all of ``capacity`` but the first."""
    first = length % capacity or capacity
    starts = [0, *range(first, length, capacity)]
    return [(start, end - start) for start, end in zip(starts, [*starts[1:], length])]


def pieces(documents: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece; ids stay behind."""
    with_code(documents.sparkSession)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                raw = np.array([*token_ids(text, path), end_id], dtype="<u4").tobytes()
                for number, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    rows.append((doc_id, number, start, length, crc))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInPandas(
        encode, "doc_id string, piece int, start long, length long, ids_crc32 long"
    ).withColumn("doc_id", F.col("doc_id").cast(kind))


@dataclass(frozen=True)
class Plan:
    """Configurations as ``{length: how many}``, each used ``times`` times."""

    runs: list[tuple[dict[int, int], int]]

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.runs)

    def lookup(self) -> pd.DataFrame:
        """Per length, in order: the first piece number, sequence and offset of each stretch."""
        rows, base, used = [], 0, {}
        for configuration, times in self.runs:
            offset = 0
            for length, many in sorted(configuration.items(), reverse=True):
                for _ in range(many):
                    rows.append((length, used.get(length, 0), base, offset))
                    used[length] = used.get(length, 0) + times
                    offset += length
            base += times
        table = pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"])
        return table.sort_values(["length", "first"], ignore_index=True)


def dearest(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """For each room up to ``capacity``, what to put in first (or -1) to fill it most dearly.

    A knapsack dynamic program over rooms.  ``lengths`` decrease; of equally dear choices
    the longest counts, since long pieces are the harder ones to place later.
    """
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    shorter = len(lengths) - np.searchsorted(lengths[::-1], np.arange(capacity + 1), side="right")
    for room in range(int(lengths[-1]), capacity + 1):
        start = shorter[room]
        value = best[room - lengths[start:]] + prices[start:]
        top = int(value.argmax())
        if value[top] > best[room - 1]:
            best[room], choice[room] = value[top], start + top
        else:
            best[room], choice[room] = best[room - 1], choice[room - 1]
    return choice


def weighted(counts: np.ndarray, capacity: int, tilt: float) -> list[tuple[dict[int, int], float]]:
    """Fractional multiplicities of configurations, by multiplicative weights on coverage.

    The price of a length falls with the share of its pieces that is covered so far.  Each
    round of pricing gives the dearest configuration around each of the lengths that are
    covered least, and each is used until it has covered a part of one of its lengths.
    """
    lengths = np.flatnonzero(counts)[::-1]
    need = counts[lengths].astype(float)
    # If more than in proportion, short pieces are kept for the gaps at the end.
    worth = lengths * (lengths / capacity) ** tilt
    covered = np.zeros(len(lengths))
    amounts: dict[tuple[int, ...], float] = {}
    for _ in range(UPDATES):
        ahead = covered - covered.mean()
        prices = worth * np.exp(-STEP * ahead)
        choice = dearest(lengths, prices, capacity)
        for place in np.argsort(covered, kind="stable")[:AROUND]:
            chosen, room = [place], capacity - lengths[place]
            while choice[room] >= 0:
                chosen.append(choice[room])
                room -= lengths[choice[room]]
            places, many = np.unique(chosen, return_counts=True)
            gain = many / need[places]
            amount = PART / gain.max()
            key = tuple(sorted(chosen))
            amounts[key] = amounts.get(key, 0.0) + amount
            covered[places] += amount * gain
    # So much is covered that hardly any length is used up before the others.
    most = np.quantile(covered, EVEN)
    found = []
    for key, amount in sorted(amounts.items(), key=lambda item: (-item[1], item[0])):
        places, many = np.unique(key, return_counts=True)
        found.append((dict(zip(lengths[places].tolist(), many.tolist())), amount / most))
    return found


def best_fit(
    counts: np.ndarray, capacity: int, begun: list[tuple[dict[int, int], int]]
) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram, into sequences begun before and new ones.

    Pieces of one length go, longest first, where the least room is left that holds them.
    Sequences of equal content are one entry, so the work depends on the capacity alone.
    """
    rooms: dict[int, list[tuple[dict[int, int], int]]] = {}
    for inside, number in begun:
        filled = sum(length * many for length, many in inside.items())
        rooms.setdefault(capacity - filled, []).append((inside, number))
    for length in map(int, np.flatnonzero(counts)[::-1]):
        left = int(counts[length])
        while left:
            room = min((r for r in rooms if r >= length), default=capacity)
            if rooms.get(room):
                content, times = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            else:
                content, times = {}, -(-left // (capacity // length))
            # The tightest place for the next piece is the sequence it was just put into.
            most = min(room // length, left)
            full = min(times, left // most)
            moves = [(content, times - full, 0), (content, full, most)]
            left -= full * most
            if full < times and left and left < most:
                moves = [(content, times - full - 1, 0), (content, 1, left), (content, full, most)]
                left = 0
            for inside, number, more in moves:
                if number and (inside or more):
                    grown = {**inside, length: inside.get(length, 0) + more} if more else inside
                    rooms.setdefault(room - more * length, []).append((grown, number))
    return [entry for entries in rooms.values() for entry in entries]


def times_in(configuration: dict[int, int], counts: np.ndarray) -> int:
    return min(int(counts[length]) // many for length, many in configuration.items())


def plan(counts: np.ndarray, capacity: int) -> Plan:
    """Use up ``counts[length]`` pieces of each length; work depends on the capacity alone."""
    return min((_planned(counts, capacity, tilt) for tilt in TILTS), key=lambda p: p.sequences)


def _planned(counts: np.ndarray, capacity: int, tilt: float) -> Plan:
    left, runs = counts.astype(np.int64).copy(), []

    def take(configuration: dict[int, int], times: int) -> None:
        if times > 0:
            runs.append((configuration, times))
            for length, many in configuration.items():
                left[length] -= times * many

    if left[capacity]:
        take({capacity: 1}, int(left[capacity]))
    if left.any():
        for configuration, amount in weighted(left, capacity, tilt):
            take(configuration, min(int(amount), times_in(configuration, left)))
    return Plan(best_fit(left, capacity, runs))


def packed(
    documents: DataFrame, path: str, capacity: int = 1024, end_id: int = 2
) -> DataFrame:
    """Every piece with its sequence and its offset there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    rows = pinned(pieces(documents, path, capacity, end_id))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["length"]] = row["n"]
    found = plan(counts, capacity).lookup()
    lengths, first = found["length"].to_numpy(np.int64), found["first"].to_numpy(np.int64)
    sequence, offset = found["sequence"].to_numpy(np.int64), found["offset"].to_numpy(np.int64)
    keys = (lengths << 44) + first

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (length.to_numpy() << 44) + number.to_numpy(), side="right") - 1
        return pd.DataFrame(
            {"sequence_id": sequence[at] + number.to_numpy() - first[at], "offset": offset[at]}
        )

    ranked = numbered(rows, ["length"], ["doc_id", "piece"], "_number", int(counts.sum()))
    return ranked.withColumn("_place", place("length", "_number")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset"
    )
