"""Submissions: reading, profiling, and splitting off what cannot be processed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_text, is_blank, strip
from .schemas import SEGMENT, SUBMISSIONS

# --- fixed values -----------------------------------------------------------
NO_INPUT = "Neither text nor image was provided."
MISSING_IMAGE = "Provided image path does not exist: "
NO_USABLE_TEXT = "No usable text was extracted from inputs."
FAILED_FLAG = "input_processing_error"
# ----------------------------------------------------------------------------


def read_submissions(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Batch table of submissions from parquet, JSON, CSV or any installed format."""
    return spark.read.format(file_format).schema(SUBMISSIONS).load(path)


def stream_submissions(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """The same table as an unbounded one."""
    return spark.readStream.format(file_format).schema(SUBMISSIONS).load(path)


def has_text() -> Column:
    return ~is_blank(F.col("text"))


def has_image() -> Column:
    return as_text(F.col("image_id")) != ""


def with_presence(submissions: DataFrame) -> DataFrame:
    """Add ``had_text`` and ``had_image``."""
    return submissions.withColumns({"had_text": has_text(), "had_image": has_image()})


def reject_reason(submissions: DataFrame, images: DataFrame) -> DataFrame:
    """Add ``reason``: null for usable rows, else why the row cannot be processed.

    ``images`` lists the ``image_id`` values that exist.  Rows without an image do
    not take part in the join, so they cannot pile up on its null key.
    """
    known = images.select(F.col("image_id").cast("string")).distinct().withColumn("_found", F.lit(True))
    with_image = submissions.filter(has_image())
    without = submissions.filter(~has_image())
    checked = with_image.join(known, "image_id", "left").withColumn(
        "reason",
        F.when(F.col("_found").isNull(), F.concat(F.lit(MISSING_IMAGE), "image_id")),
    )
    empty = without.withColumn("reason", F.when(~has_text(), F.lit(NO_INPUT)))
    return checked.drop("_found").unionByName(empty)


def with_fallback(rows: DataFrame) -> DataFrame:
    """Put the fallback result into every row that has a ``reason``, and drop that column.

    ``had_text`` of such a row only asks whether any text came in, blank or not.
    """
    text = as_text(F.col("text"))
    fallback = {
        "processed_text": strip(text),
        "pre_translation_text": strip(text),
        "original_language": F.lit("en"),
        "language_confidence": F.lit(0.0),
        "was_translated": F.lit(False),
        "had_text": text != "",
        "segments": F.array().cast(f"ARRAY<{SEGMENT}>"),
        "ocr_confidence": F.lit(None).cast("double"),
        "quality_flags": F.array(F.lit(FAILED_FLAG)),
        "translated_segments": F.lit(0),
        "errors": F.array("reason"),
    }
    good = F.col("reason").isNull()
    return rows.withColumns(
        {name: F.when(good, F.col(name)).otherwise(value) for name, value in fallback.items()}
    ).drop("reason")
