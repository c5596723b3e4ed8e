"""Text blocks recognised in images: geometry, lines, reading order, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_text, strip
from .cleaning import flags_of
from .groups import GROUP_ROW_LIMIT, OrderedGroups

# --- fixed values -----------------------------------------------------------
#: Blocks share a line while their centres are closer than this share of a height.
LINE_OVERLAP = 0.55
LOW_AVERAGE, LOW_BLOCK = 0.50, 0.40
FLAG_LOW_AVERAGE = "low_average_ocr_confidence"
FLAG_MANY_LOW = "multiple_low_confidence_blocks"
FLAG_EMPTY_RESULT = "empty_ocr_result"
FLAG_EMPTY_TEXT = "empty_ocr_text"
# ----------------------------------------------------------------------------


def geometry(blocks: DataFrame) -> DataFrame:
    """Extent of each block; blocks with blank text are dropped."""
    xs = F.transform("box", lambda p: p["x"])
    ys = F.transform("box", lambda p: p["y"])
    return (
        blocks.withColumn("text", strip(as_text(F.col("text"))))
        .filter(F.col("text") != "")
        .withColumns(
            {
                "min_x": F.array_min(xs),
                "max_x": F.array_max(xs),
                "min_y": F.array_min(ys),
                "max_y": F.array_max(ys),
            }
        )
        .withColumns(
            {
                "center_y": (F.col("min_y") + F.col("max_y")) / 2.0,
                "height": F.greatest(F.lit(1.0), F.col("max_y") - F.col("min_y")),
            }
        )
    )


def _in_lines(blocks: DataFrame, row_limit: int) -> OrderedGroups:
    starts_line = F.col("_y").isNull() | ~(
        F.abs(F.col("center_y") - F.col("_y"))
        < F.greatest(F.col("_h"), F.col("height")) * LINE_OVERLAP
    )
    return (
        OrderedGroups.of(
            geometry(blocks), ["image_id"], ["center_y", "block_no"], row_limit, measured=blocks,
            size=F.octet_length("text"),
        )
        .previous({"_y": "center_y", "_h": "height"})
        .running_sum("line_no", F.when(starts_line, 1).otherwise(0))
    )


def lines(blocks: DataFrame, row_limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """Add ``line_no`` (from 1): a block starts a line unless it overlaps the block above it."""
    return _in_lines(blocks, row_limit).frame().drop("_y", "_h")


def _in_reading_order(blocks: DataFrame, row_limit: int) -> OrderedGroups:
    return (
        _in_lines(blocks, row_limit)
        .reorder(["line_no", "min_x", "center_y", "block_no"], row_limit)
        .position("reading_order", start=0)
    )


def reading_order(blocks: DataFrame, row_limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """Add ``reading_order`` (from 0): line by line, left to right; confidence to 4 digits."""
    ordered = _in_reading_order(blocks, row_limit).frame().drop("_y", "_h")
    return ordered.withColumn("confidence", F.round("confidence", 4))


def documents(blocks: DataFrame, row_limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """One row per image with blocks: text in reading order, confidence and flags."""
    rounded = F.round("confidence", 4)
    joined = _in_reading_order(blocks, row_limit).join_text(
        F.col("text"),
        " ",
        "text",
        "reading_order",
        sum_confidence=F.sum(rounded),
        count_blocks=F.count(F.lit(1)),
        sum_low=F.sum(F.when(rounded < LOW_BLOCK, 1).otherwise(0)),
    )
    average = F.col("sum_confidence") / F.col("count_blocks")
    return joined.select(
        "image_id",
        "text",
        F.round(average, 4).alias("average_confidence"),
        F.col("count_blocks").alias("block_count"),
        flags_of(
            (average < LOW_AVERAGE, FLAG_LOW_AVERAGE),
            (F.col("sum_low") > F.col("count_blocks") / 3, FLAG_MANY_LOW),
        ).alias("quality_flags"),
    )


def documents_for(images: DataFrame, documents: DataFrame) -> DataFrame:
    """A row for every listed image; one without blocks has empty text and says so."""
    joined = images.select("image_id").distinct().join(documents, "image_id", "left")
    return joined.select(
        "image_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("average_confidence", F.lit(0.0)).alias("average_confidence"),
        F.coalesce("block_count", F.lit(0).cast("bigint")).alias("block_count"),
        F.coalesce("quality_flags", F.array(F.lit(FLAG_EMPTY_RESULT))).alias("quality_flags"),
    )


def blocks_in_order(ordered: DataFrame) -> DataFrame:
    """The nested form: per image, its blocks as one array in reading order.

    The array is one cell, so an image must fit in a row; the flat form of
    :func:`reading_order` has no such limit.
    """
    block = F.struct(F.col("reading_order").alias("order"), "text", "confidence", "box")
    return ordered.groupBy("image_id").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
