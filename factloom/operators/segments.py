"""From submissions to claim-ready text.

Recognised text is worked on per image, so an image that many submissions share
is cleaned and translated once.  Submissions are read in two parts.  Those with
neither an image nor Telugu text need nothing from other rows and are finished
where they are read; only the others go through the join on the image and the
join on their translated sentences.  Everything else happens inside the row: no
segments are regrouped, and rows that fail get their fallback values in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.language import (
    ENGLISH, MIXED, confidence_of, has_telugu, language_of, latin_count, telugu_count,
)
from ..functions.text import as_text, is_blank, normalize_text, strip
from ..sources.schemas import SEGMENT
from ..sources.submissions import MISSING_IMAGE, NO_INPUT, NO_USABLE_TEXT, with_presence
from .cleaning import clean
from .groups import GROUP_ROW_LIMIT
from .ocr import FLAG_EMPTY_TEXT, reading_order
from .translation import needs_translation, sentence_answers, translated_text

_FIELDS = [
    "original_text", "detected_language", "language_confidence", "normalized_text",
    "translated_text", "quality_flags",
]


def with_language(frame: DataFrame, text: str = "original_text") -> DataFrame:
    """Add ``detected_language`` and ``language_confidence`` of the raw text.

    The letter counts are columns of their own, because the rules read them often.
    """
    value = as_text(F.col(text))
    counted = frame.withColumns(
        {"_telugu": telugu_count(value), "_latin": latin_count(value), "_blank": is_blank(value)}
    )
    counts = F.col("_telugu"), F.col("_latin"), F.col("_blank")
    return counted.withColumns(
        {
            "detected_language": language_of(*counts),
            "language_confidence": confidence_of(*counts),
        }
    ).drop("_telugu", "_latin", "_blank")


def with_clean_text(frame: DataFrame, text: str = "original_text") -> DataFrame:
    """Add ``normalized_text`` (normalised, then cleaned) and ``quality_flags``."""
    normalised = frame.withColumn("_normal", normalize_text(F.col(text)))
    return clean(normalised, "_normal", "normalized_text", "quality_flags", lines=False).drop(
        "_normal"
    )


def _with_translation(rows: DataFrame) -> DataFrame:
    """``translated_text`` from ``answers``, for Telugu and mixed texts only."""
    told = F.when(needs_translation(), translated_text("normalized_text"))
    return rows.withColumn("translated_text", told).drop("answers")


def image_sides(documents: DataFrame, memory: DataFrame) -> DataFrame:
    """Images with an ``ocr`` struct; ``original_text`` in it is null if nothing was read.

    Documents are partitioned by image already, so their join with the answers
    moves only the answers.
    """
    images = documents.select(
        "image_id",
        F.nullif(strip(F.col("text")), F.lit("")).alias("original_text"),
        F.col("average_confidence").alias("ocr_confidence"),
        F.col("quality_flags").alias("image_flags"),
    )
    worked = with_clean_text(with_language(images))
    answers = sentence_answers(
        worked.filter(needs_translation()), ["image_id"], "normalized_text", memory
    )
    return _with_translation(worked.join(answers, "image_id", "left")).select(
        "image_id", F.struct(*_FIELDS, "ocr_confidence", "image_flags").alias("ocr")
    )


def named_images(submissions: DataFrame) -> DataFrame:
    """The distinct images that submissions name."""
    return with_presence(submissions).filter("had_image").select("image_id").distinct()


def segment_blocks(
    submissions: DataFrame, images: DataFrame, blocks: DataFrame, row_limit: int = GROUP_ROW_LIMIT
) -> DataFrame:
    """Where the text of each OCR segment stands in its image, one row per text block.

    Keyed by (submission_id, order) of the segment and ``block_order``.  Flat, so an image
    may have any number of blocks, and blocks shared by submissions are ordered once.
    """
    named = named_images(submissions).join(images.select("image_id"), "image_id", "left_semi")
    ordered = reading_order(blocks.join(named, "image_id", "left_semi"), row_limit)
    shown = with_presence(submissions).filter("had_image").select(
        "submission_id", "image_id", F.col("had_text").cast("int").alias("order")
    )
    return ordered.join(shown, "image_id").select(
        "submission_id", "order", F.col("reading_order").alias("block_order"), "block_no",
        "text", "confidence", "min_x", "min_y", "max_x", "max_y",
    )


def side_by_side(submissions: DataFrame, documents: DataFrame, memory: DataFrame) -> DataFrame:
    """One row per submission with its ``user`` and ``ocr`` structs and a ``reason``.

    ``user`` is null without text and ``ocr`` without a known image; ``reason`` says
    why a row cannot be processed, or is null.  ``documents`` lists every image that
    exists.  In the image join, rows without an image carry a key of their own, so
    they spread instead of piling up on null.
    """
    present = with_presence(submissions).withColumn("original_text", strip(as_text(F.col("text"))))
    joins = F.col("had_image") | has_telugu(F.col("original_text"))
    alone = with_clean_text(with_language(present.filter(~joins)))
    others = with_clean_text(with_language(present.filter(joins)))

    answers = sentence_answers(
        others.filter(needs_translation()), ["submission_id"], "normalized_text", memory
    )
    images = image_sides(documents, memory).withColumnRenamed("image_id", "_image")
    key = F.when(F.col("had_image"), F.col("image_id")).otherwise(
        F.concat(F.lit("\0"), F.col("submission_id").cast("string"))
    )
    joined = (
        others.withColumn("_key", key)
        .join(answers, "submission_id", "left")
        .join(images, F.col("_key") == F.col("_image"), "left")
        .drop("_key", "_image")
    )
    apart = alone.withColumns(
        {
            name: F.lit(None).cast(joined.schema[name].dataType)
            for name in ("answers", "ocr")
        }
    )
    user = F.when(F.col("had_text"), F.struct(*_FIELDS)).alias("user")
    no_input = ~F.col("had_text") & ~F.col("had_image")
    missing = F.col("had_image") & F.col("ocr").isNull()
    reason = F.when(no_input, NO_INPUT).when(missing, F.concat(F.lit(MISSING_IMAGE), "image_id"))
    columns = [*submissions.columns, "had_text", "had_image", user, "ocr", reason.alias("reason")]
    return (
        _with_translation(joined).select(*columns).unionByName(
            _with_translation(apart).select(*columns)
        )
    )


def _segment(side: str, order: Column, confidence: Column) -> Column:
    return F.struct(
        order.cast("int").alias("order"),
        F.lit("user_text" if side == "user" else "ocr").alias("source"),
        *[F.col(f"{side}.{name}").alias(name) for name in _FIELDS[:-1]],
        confidence.cast("double").alias("ocr_confidence"),
        F.col(f"{side}.quality_flags").alias("quality_flags"),
    ).cast(SEGMENT)


def with_segments(sides: DataFrame) -> DataFrame:
    """Add ``segments``: at most a user and an OCR segment, in that order."""
    has_ocr = F.col("ocr.original_text").isNotNull()
    return sides.withColumn(
        "segments",
        F.array_compact(
            F.array(
                F.when(F.col("had_text"), _segment("user", F.lit(0), F.lit(None))),
                F.when(
                    has_ocr,
                    _segment("ocr", F.col("had_text").cast("int"), F.col("ocr.ocr_confidence")),
                ),
            )
        ),
    )


def segment_rows(sides: DataFrame) -> DataFrame:
    """The long form: one row per segment."""
    return with_segments(sides).select("submission_id", F.inline("segments"))


def with_merged_language(sides: DataFrame) -> DataFrame:
    """Add ``original_language`` and ``language_confidence`` of the whole submission."""
    read = F.col("ocr.original_text").isNotNull()
    user, ocr = F.col("user.detected_language"), F.when(read, F.col("ocr.detected_language"))
    user_at = F.col("user.language_confidence")
    ocr_at = F.when(read, F.col("ocr.language_confidence"))
    both = F.col("had_text") & (F.coalesce("ocr.normalized_text", F.lit("")) != "")
    one_language = (user == ocr) & (user != MIXED)
    return sides.withColumns(
        {
            "original_language": F.when(both & one_language, user)
            .when(both, MIXED)
            .otherwise(F.coalesce(user, ocr, F.lit(ENGLISH))),
            "language_confidence": F.when(both, F.round((user_at + ocr_at) / 2.0, 3)).otherwise(
                F.coalesce(user_at, ocr_at, F.lit(1.0))
            ),
        }
    )


def _joined(segments: Column, pick) -> Column:
    texts = F.transform(segments, pick)
    return strip(F.array_join(F.filter(texts, lambda text: text != ""), "\n"))


def _ready(segment: Column) -> Column:
    return F.coalesce(F.nullif(segment["translated_text"], F.lit("")), segment["normalized_text"])


def aggregate(sides: DataFrame) -> DataFrame:
    """The processed row of each submission; ``reason`` also tells where no usable text came out.

    Flags keep the order in which the steps raised them, each once.
    """
    merged = with_segments(with_merged_language(sides))
    segments = F.col("segments")
    empty_image = F.col("had_image") & F.col("ocr.original_text").isNull()
    none = F.array().cast("array<string>")
    flags = F.concat(
        F.coalesce("user.quality_flags", none),
        F.coalesce("ocr.image_flags", none),
        F.when(F.col("ocr.original_text").isNotNull(), F.col("ocr.quality_flags")).otherwise(none),
        F.when(empty_image, F.array(F.lit(FLAG_EMPTY_TEXT))).otherwise(none),
    )
    translated = F.size(F.filter(segments, lambda s: s["translated_text"].isNotNull()))
    usable = F.exists(segments, lambda s: s["normalized_text"] != "")
    return merged.select(
        "submission_id",
        "text",
        _joined(segments, _ready).alias("processed_text"),
        _joined(segments, lambda s: s["normalized_text"]).alias("pre_translation_text"),
        "original_language",
        "language_confidence",
        (translated > 0).alias("was_translated"),
        "had_text",
        "had_image",
        "segments",
        F.col("ocr.ocr_confidence").alias("ocr_confidence"),
        F.array_distinct(flags).alias("quality_flags"),
        translated.alias("translated_segments"),
        none.alias("errors"),
        F.coalesce("reason", F.when(~usable, F.lit(NO_USABLE_TEXT))).alias("reason"),
    )
