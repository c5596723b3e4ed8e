"""Chat formatting of logged conversations, cumulative snapshots collapsed first.

Logs hold the same conversation many times, each time some turns longer.  A rolling hash
stands for each prefix of turns: the sum of hashes of (position, role, text), in three
lanes.  A conversation is dropped if its turns begin a longer one; of equal ones the
smallest id stays.  A prefix hash that occurs in more rows than there are conversations
that end there begins a longer one, so the comparison joins two tables of distinct hashes
and no conversation with another.

What stays is rendered turn by turn and put together to texts.  Turns go by turn number,
then role, then text.  Null roles and texts count as empty ones; rows without conv_id are
one conversation with a null id; repeated rows are repeated turns.  A text holds about
``part_chars`` characters, so a conversation of any length becomes texts of bounded size;
a turn is never cut.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.groups import OrderedGroups

#: Marks of the template, and what the opening mark becomes inside a text.
OPEN, CLOSE, ESCAPED = "<|im_start|>", "<|im_end|>", "< |"
#: Characters from which on a new part of a conversation begins.
PART_CHARS = 1_000_000
#: Values of one lane of a hash.
LANE = 1 << 31

_KEYS = ["_no_id", "_id"]
_PREFIX = ["_at", "_a", "_b", "_c"]


def rendered(role: Column, text: Column) -> Column:
    """One turn in the template; marks inside the text are made harmless."""
    return F.concat(
        F.lit(OPEN), F.replace(role, F.lit("<|"), F.lit(ESCAPED)), F.lit("\n"),
        F.replace(text, F.lit("<|"), F.lit(ESCAPED)), F.lit(CLOSE + "\n"),
    )


def with_prefix_hashes(conversations: DataFrame) -> DataFrame:
    """Every turn with its position, the hash of the prefix up to it, and its part."""
    turns = conversations.select(
        F.col("conv_id").isNull().alias("_no_id"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    groups = OrderedGroups.of(turns, _KEYS, ["turn", "role", "text"]).position("_at")
    for at, lane in enumerate(_PREFIX[1:]):
        hashed = F.pmod(F.xxhash64(F.lit(at), F.col("_at").cast("int"), "role", "text"), F.lit(LANE))
        groups = groups.running_sum(lane, hashed)
    size = F.char_length(rendered(F.col("role"), F.col("text"))).cast("long")
    return groups.running_sum("_chars", size).frame()


def maximal(prefixes: DataFrame) -> DataFrame:
    """Keys of the conversations that are neither the beginning nor a later copy of another."""
    everywhere = prefixes.groupBy(*_PREFIX).agg(F.count(F.lit(1)).alias("_rows"))
    whole = (
        prefixes.groupBy(*_KEYS).agg(F.max(F.struct(*_PREFIX)).alias("_end"))
        .groupBy(*[F.col(f"_end.{name}").alias(name) for name in _PREFIX])
        .agg(F.count(F.lit(1)).alias("_ends"), F.min(F.struct(*_KEYS)).alias("_first"))
    )
    begun = everywhere.join(whole, _PREFIX).filter(F.col("_rows") > F.col("_ends"))
    return whole.join(begun.select(*_PREFIX), _PREFIX, "left_anti").select("_first.*", "_ends")


def formatted(conversations: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, copies, turns, text: maximal conversations as training texts."""
    prefixes = with_prefix_hashes(conversations)
    turns = prefixes.join(maximal(prefixes), _KEYS)
    chars = F.char_length(rendered(F.col("role"), F.col("text")))
    part = F.floor((F.col("_chars") - chars) / part_chars).cast("int")
    ordered = F.sort_array(F.collect_list(F.struct("_at", rendered(F.col("role"), F.col("text")).alias("text"))))
    return (
        turns.groupBy(*_KEYS, part.alias("part"), F.col("_ends").alias("copies"))
        .agg(F.count(F.lit(1)).alias("turns"), ordered.alias("_turns"))
        .select(
            F.when(~F.col("_no_id"), F.col("_id")).alias("conv_id"),
            "part", "copies", "turns",
            F.array_join(F.transform("_turns", lambda turn: turn["text"]), "").alias("text"),
        )
    )
