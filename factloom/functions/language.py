"""Script-based language identification (English, Telugu or a mixture)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_ascii, is_blank, let

# --- fixed values -----------------------------------------------------------
ENGLISH, TELUGU, MIXED = "en", "te", "mixed"
TELUGU_LETTERS = r"[\u0C00-\u0C7F]"
LATIN_LETTERS = "[a-zA-Z]"
#: Both scripts need this share and this many letters for a text to be mixed.
MIXED_SHARE, MIXED_LETTERS = 0.10, 3
#: Confidence of text that holds neither script.
NEITHER_SCRIPT = 0.50
# ----------------------------------------------------------------------------


def _count(value: Column, letters: str) -> Column:
    """Letters of one class, counted by how much shorter the text is without them."""
    return F.length(value) - F.length(F.regexp_replace(value, letters + "+", ""))


def telugu_count(value: Column) -> Column:
    return F.when(is_ascii(value), 0).otherwise(_count(value, TELUGU_LETTERS))


def latin_count(value: Column) -> Column:
    return _count(value, LATIN_LETTERS)


def has_telugu(value: Column) -> Column:
    return value.rlike(TELUGU_LETTERS)


def language_of(telugu: Column, latin: Column, blank: Column) -> Column:
    """Language code from the two letter counts."""
    return (
        F.when(blank, ENGLISH)
        .when(_is_mixed(telugu, latin), MIXED)
        .when(telugu > latin, TELUGU)
        .otherwise(ENGLISH)
    )


def confidence_of(telugu: Column, latin: Column, blank: Column) -> Column:
    """Confidence that belongs to :func:`language_of`, in [0, 1]."""
    total = telugu + latin
    both = (telugu > 0) & (latin > 0)
    leading = F.greatest(telugu, latin)
    mixed = F.least(F.lit(0.98), 0.70 + 0.30 * F.least(F.lit(1.0), total / 15.0))
    dominant = F.least(F.lit(0.99), 0.75 + 0.25 * (leading / F.greatest(total, F.lit(1))))
    single = F.least(F.lit(0.99), 0.75 + 0.25 * F.least(F.lit(1.0), leading / 10.0))
    return F.round(
        F.when(blank, F.lit(0.0))
        .when(_is_mixed(telugu, latin), mixed)
        .when(both, dominant)
        .when(total > 0, single)
        .otherwise(F.lit(NEITHER_SCRIPT)),
        3,
    )


def _is_mixed(telugu: Column, latin: Column) -> Column:
    fewer = F.least(telugu, latin)
    share = fewer / F.greatest(telugu + latin, F.lit(1))
    return (fewer >= MIXED_LETTERS) & (share >= MIXED_SHARE)


def detect_language(value: Column) -> Column:
    """Struct ``<language, confidence>`` of a text; null and blank are English at 0.0.

    The rules read the letter counts many times; ``let`` has them counted once.
    """
    counts = F.struct(
        F.coalesce(telugu_count(value), F.lit(0)).alias("telugu"),
        F.coalesce(latin_count(value), F.lit(0)).alias("latin"),
        is_blank(value).alias("blank"),
    )
    return let(
        counts,
        lambda c: F.struct(
            language_of(c["telugu"], c["latin"], c["blank"]).alias("language"),
            confidence_of(c["telugu"], c["latin"], c["blank"]).alias("confidence"),
        ),
    )
