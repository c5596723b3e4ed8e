"""Sentence splitting and masking of web addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

# --- fixed values -----------------------------------------------------------
_SPACE = r"\s\x1c-\x1f"
_MARKS = r".?!।\n"
#: A run of end marks, when white space or the end of the text follows.
SENTENCE_END = rf"(?U)([{_MARKS}]+(?:[{_SPACE}]+|\z))"
URL = rf"(?iU)https?://[^{_SPACE}]+|www\.[^{_SPACE}]+"
#: Stands for the n-th address of a sentence while it is translated.
URL_KEY_PREFIX, URL_KEY_SUFFIX = "__PROTECTED_URL_", "__"
# ----------------------------------------------------------------------------


def split_sentences(value: Column) -> Column:
    """Array of sentences.

    A sentence keeps its end mark, unless the words before the mark hold an end
    mark themselves (a decimal or an address does); then the mark is left out.
    Pieces without a letter or digit are dropped; if nothing is left the trimmed
    text stands for itself, and the empty text has no sentences.
    """
    bodies = F.split(value, SENTENCE_END)
    ends = F.regexp_extract_all(value, F.lit(SENTENCE_END), F.lit(0))

    def finish(body: Column, end: Column) -> Column:
        whole = F.concat(body, F.coalesce(end, F.lit("")))
        return strip(F.when(body.rlike(f"[{_MARKS}]"), body).otherwise(whole))

    found = F.filter(F.zip_with(bodies, ends, finish), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    kept = let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(strip(value))))
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        kept
    )


def urls_in(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(URL), F.lit(0))


def url_key(at: Column) -> Column:
    return F.concat(F.lit(URL_KEY_PREFIX), at.cast("string"), F.lit(URL_KEY_SUFFIX))


def protect_urls(value: Column) -> Column:
    """The text with its n-th address replaced by the n-th key (counted from 0)."""
    pieces = F.split(value, URL)
    keyed = let(
        pieces,
        lambda parts: F.array_join(
            F.transform(
                parts,
                lambda part, at: F.when(
                    at < F.size(parts) - 1, F.concat(part, url_key(at))
                ).otherwise(part),
            ),
            "",
        ),
    )
    return F.when(value.rlike(URL), keyed).otherwise(value)


def restore_urls(value: Column, urls: Column) -> Column:
    """Put addresses back; a key may occur any number of times, or not at all."""
    numbered = F.transform(urls, lambda url, at: F.struct(url_key(at).alias("key"), url.alias("url")))
    return F.when(
        F.size(urls) > 0,
        F.aggregate(numbered, value, lambda text, item: F.replace(text, item["key"], item["url"])),
    ).otherwise(value)
