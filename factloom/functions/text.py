"""Normalisation and cleaning of text, as Column expressions.

Everything here but the Unicode composition stays inside the JVM.  Patterns are Java regular expressions
and are written so that a scan over a long text is linear: runs are matched
possessively or guarded by a look-behind, and there are no nested groups whose
matching recurses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode_forms import composed

# --- fixed values -----------------------------------------------------------
#: Every character that counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
FLAG_CONTROL = "control_characters_removed"
FLAG_NOISE = "ocr_symbol_noise_cleaned"
FLAG_REPEATED = "repeated_lines_removed"
#: Symbol-only tokens that carry meaning and therefore stay.
KEPT_SYMBOL_TOKENS = r"\.\.\.?|!!!?|\?\?\??|---?|==|[-+%$₹€]"
#: A symbol-only token holding one of these is recognition noise.
NOISE_CHARACTERS = r"@#^~|\\_`"
#: A symbol-only token made of nothing else is ordinary punctuation.
PUNCTUATION_CHARACTERS = r".,!?;:'\"\-–—()\[\]{}"
# ----------------------------------------------------------------------------

_WS = r"\s\x1c-\x1f"
_BLANK = f"(?U)[{_WS}]"
_SOLID = f"[^{_WS}]"

_NOISE_TOKEN = (
    rf"(?U)(?![\p{{L}}\p{{N}}{_WS}])(?<!{_SOLID})"
    f"(?!(?:{KEPT_SYMBOL_TOKENS})(?!{_SOLID}))"
    f"(?:(?={_SOLID}*[{NOISE_CHARACTERS}])"
    f"|(?={_SOLID}{{2}})(?={_SOLID}*[^{PUNCTUATION_CHARACTERS}{_WS}]))"
    rf"[^\p{{L}}\p{{N}}{_WS}]++(?!{_SOLID})"
)
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+"
#: Gaps that normalisation closes, in one pass; each alternative has its own left context.
_GAPS = (
    rf"(?U)(?=[{_WS}.,])(?:"
    rf"(?<=\d)(?:[{_WS}]+([.,])[{_WS}]*|([.,])[{_WS}]+)(?=\d)"
    rf"|(?<=[₹$€£¥])[{_WS}]+(?=\d)"
    rf"|(?<=\d)[{_WS}]+(?=[%％])"
    rf"|(?<=[a-zA-Z\u0C00-\u0C7F)\]'\"])[{_WS}]+(?=[.,!?;:](?:[{_WS}]|\z)))"
)


#: Characters that composition may change or join to the one before them, and some more: marks,
#: conjoining letters, compatibility forms, and what Java does not know yet.  No other does.
UNSTABLE = (
    r"\p{M}\p{Cn}\u0340-\u0387\u1100-\u11ff\u1f71-\u2001\u2126-\u212b\u2329\u232a\u2adc"
    r"\u0958-\u095f\u09dc-\u09df\u0a33-\u0a36\u0a59-\u0a5e\u0b5c-\u0b5d\u0f43-\u0f69"
    r"\uf900-\ufb4e\x{1d15e}-\x{1d164}\x{1d1bb}-\x{1d1c0}\x{2f800}-\x{2fa1f}"
)
#: The same with a first comparison that settles most characters.
_UNSTABLE = rf"[\u0300-\x{{10ffff}}&&[{UNSTABLE}]]"
#: A stretch to compose by itself: one other character, if there is one, and what follows it.
_STRETCH = rf"[^\n]?{_UNSTABLE}++"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def as_text(value: Column) -> Column:
    """The value as a string, with null read as the empty string."""
    return F.coalesce(value.cast("string"), F.lit(""))


def strip(value: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.btrim(value, F.lit(WHITESPACE))


def is_blank(value: Column) -> Column:
    """True for null, empty and white-space-only text; never null."""
    return strip(as_text(value)) == ""


def collapse_whitespace(value: Column) -> Column:
    """Each run of white space becomes one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(value, f"{_BLANK}+", " "))


def is_ascii(value: Column) -> Column:
    """Whether the text has one byte per character."""
    return F.octet_length(value) == F.char_length(value)


def compose_unicode(value: Column) -> Column:
    """Unicode canonical composition (NFC).

    The one step that Spark's own functions lack.  Only the stretches of a text that it may
    change leave the JVM, joined by line feeds (which compose with nothing), as Arrow batches;
    they are put back between the parts that stay.
    """
    stretches = F.regexp_extract_all(value, F.lit(_STRETCH), F.lit(0))
    some = ~is_ascii(value) & value.rlike(_UNSTABLE)
    changed = composed(F.when(some, F.array_join(stretches, "\n")))
    woven = F.zip_with(
        F.split(value, _STRETCH, -1),
        F.concat(F.split(changed, "\n", -1), F.array(F.lit(""))),
        lambda kept, made: F.concat(kept, made),
    )
    return F.when(changed.isNotNull(), F.array_join(woven, "")).otherwise(value)


def flatten_breaks(value: Column) -> Column:
    """Line breaks and tabs become spaces."""
    return F.regexp_replace(value, r"\r\n|[\r\n\t]", " ")


def drop_zero_width(value: Column) -> Column:
    """Remove byte-order marks and zero-width spaces; no-break space becomes a space.

    Joiners stay, since scripts with conjuncts need them.
    """
    return F.translate(value, "\u00a0\ufeff\u200b", " ")


def join_numbers(value: Column) -> Column:
    """Close the gaps inside decimals, after currency signs and before percent signs."""
    value = F.regexp_replace(value, rf"(?U)(?<=\d)[{_WS}]*([.,])[{_WS}]*(?=\d)", "$1")
    value = F.regexp_replace(value, rf"(?U)([₹$€£¥])[{_WS}]+(\d)", "$1$2")
    return F.regexp_replace(value, rf"(?U)(\d)[{_WS}]+([%％])", "$1$2")


def attach_punctuation(value: Column) -> Column:
    """Remove the gap between a word (or closing mark) and its sentence punctuation."""
    return F.regexp_replace(
        value,
        rf"(?U)([a-zA-Z\u0C00-\u0C7F)\]'\"])[{_WS}]+([.,!?;:])(?=[{_WS}]|\z)",
        "$1$2",
    )


def calm_punctuation(value: Column) -> Column:
    """A run of ``!``/``?`` keeps its last mark; four or more dots become three."""
    value = F.regexp_replace(value, "[!?]+([!?])", "$1")
    return F.regexp_replace(value, r"\.{4,}", "...")


def _if_any(value: Column, marks: list[str], change) -> Column:
    """Apply ``change`` only to texts that hold one of the marks.

    Finding a plain string is far cheaper than a pass of a pattern, and most texts
    need no change.
    """

    def choose(text: Column) -> Column:
        found = F.contains(text, F.lit(marks[0]))
        for mark in marks[1:]:
            found = found | F.contains(text, F.lit(mark))
        return F.when(found, change(text)).otherwise(text)

    return let(value, choose)


def normalize_text(value: Column) -> Column:
    """Conservative normalisation; letter case is never changed.

    The steps above, in as few passes as give the same result.  Line breaks, tabs
    and no-break spaces need none of their own: every pattern takes them as white
    space, and the last pass turns all white space into single spaces.
    """
    value = compose_unicode(as_text(value))
    value = _if_any(value, ["\ufeff", "\u200b"], lambda t: F.translate(t, "\ufeff\u200b", ""))
    value = F.regexp_replace(value, _GAPS, "$1$2")
    value = _if_any(value, ["!!", "!?", "?!", "??", "...."], calm_punctuation)
    return collapse_whitespace(value)


def drop_control_characters(value: Column) -> Column:
    return F.regexp_replace(value, _CONTROL, "")


def drop_noise_tokens(value: Column) -> Column:
    """Remove tokens that are recognition noise, keeping the white space around them."""
    return F.regexp_replace(value, _NOISE_TOKEN, "")


def _trim_each_line(value: Column) -> Column:
    value = F.regexp_replace(value, rf"(?U)(?<![^\n])[{_WS}&&[^\n]]++", "")
    return F.regexp_replace(
        value, rf"(?U)(?<![{_WS}&&[^\n]])[{_WS}&&[^\n]]++(?![^\n])", ""
    )


def tidy_lines(value: Column) -> Column:
    """Collapse blanks and trim every line, without splitting the text."""
    return _trim_each_line(F.regexp_replace(value, "[ \t]+", " "))


def tidy_spaces(value: Column) -> Column:
    """:func:`tidy_lines` for text that was normalised before: only space runs are left."""
    return strip(_if_any(value, ["  "], lambda text: F.regexp_replace(text, " {2,}", " ")))


def _without_repeats(text: Column, key) -> Column:
    """Drop each non-empty line whose key equals that of the non-empty line before it.

    Empty lines stay in place and do not interrupt the comparison.  The previous
    key is read from a shifted copy of the array, so the work is linear and the
    row never leaves its partition.
    """
    lines = F.transform(
        F.split(text, "\n"),
        lambda line, at: F.struct(at.alias("at"), line.alias("line"), key(line).alias("key")),
    )
    filled = F.filter(lines, lambda item: item["line"] != "")
    empty = F.filter(lines, lambda item: item["line"] == "")
    before = F.concat(
        F.array(F.lit(None).cast("string")), F.transform(filled, lambda item: item["key"])
    )
    paired = F.zip_with(
        filled, before, lambda item, last: F.struct(item.alias("item"), last.alias("last"))
    )
    fresh = F.filter(
        paired,
        lambda pair: pair["item"].isNotNull() & ~pair["item"]["key"].eqNullSafe(pair["last"]),
    )
    kept = F.sort_array(F.concat(F.transform(fresh, lambda pair: pair["item"]), empty))
    return F.array_join(F.transform(kept, lambda item: item["line"]), "\n")


def _per_line(value: Column, key) -> Column:
    return let(
        value,
        lambda text: F.when(F.contains(text, F.lit("\n")), _without_repeats(text, key)).otherwise(
            text
        ),
    )


def drop_repeated_lines(tidied: Column) -> Column:
    """Drop repeats from text whose lines are tidy already; case is ignored."""
    return _per_line(tidied, F.lower)


def dedupe_lines(value: Column) -> Column:
    """Stand-alone repeat removal; text of one line is returned exactly as it came.

    Lines are trimmed, and compared with all their white space collapsed.
    """
    text = as_text(value)
    by_words = _per_line(_trim_each_line(text), lambda line: F.lower(collapse_whitespace(line)))
    return F.when(F.contains(text, F.lit("\n")), by_words).otherwise(text)


def clean_text(value: Column) -> Column:
    """All cleaning steps without the flags; for the flags see ``operators.cleaning``."""
    value = drop_noise_tokens(drop_control_characters(as_text(value)))
    return strip(drop_repeated_lines(tidy_lines(value)))
