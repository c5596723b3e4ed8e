"""One claim per text: extractive choice, tidying of model answers, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.centrality import central
from ..functions.sentences import split_sentences
from ..functions.text import as_text, collapse_whitespace, is_blank, strip

# --- fixed values -----------------------------------------------------------
#: Lead-ins that models put before a claim; stripped in this order, once each.
LEAD_INS = [
    "Claim:", "CLAIM:", "Main Claim:", "Main claim:",
    "Extracted Claim:", "Extracted claim:", "Output:", "OUTPUT:",
]
CLAIM_ERROR = "claim_extraction_error: "
#: Words a claim should have.
FEWEST_WORDS, MOST_WORDS = 10, 30
# ----------------------------------------------------------------------------

#: Words that may link two sentences: four letters or digits at least.
LINKING_WORD = r"[\p{L}\p{M}\p{N}]{4,}"

_SPACE = r"(?U)[\s\x1c-\x1f]"


def sentence_score(sentence: Column) -> Column:
    """How claim-like a sentence is: length, numbers, amounts and names."""
    words = F.size(F.split(sentence, f"{_SPACE}+"))
    names = F.size(F.regexp_extract_all(sentence, F.lit(rf"{_SPACE}\p{{Lu}}"), F.lit(0)))
    return (
        F.when(words.between(FEWEST_WORDS, MOST_WORDS), 2).otherwise(0)
        + F.when(sentence.rlike(r"\p{Nd}"), 1).otherwise(0)
        + F.when(sentence.rlike("[%₹$€]"), 1).otherwise(0)
        + F.least(F.lit(3), names)
    )


def best_sentence(text: Column) -> Column:
    """The highest-scoring sentence, the earliest of equals; null if there is none.

    The choice is a maximum over the row's own sentences, so no sentence leaves
    its row and nothing is shuffled.
    """
    ranked = F.transform(
        split_sentences(text),
        lambda sentence, at: F.struct(
            sentence_score(sentence).alias("score"),
            (-at).alias("rank"),
            sentence.alias("sentence"),
        ),
    )
    return F.array_max(ranked)["sentence"]


def clean_claim(value: Column) -> Column:
    """Strip lead-ins, quotes and a leading ``1.``; one line, single spaces."""
    claim = strip(as_text(value))
    for lead_in in LEAD_INS:
        claim = F.regexp_replace(claim, rf"\A\Q{lead_in}\E(?U)[\s\x1c-\x1f]*", "")
    claim = F.btrim(F.btrim(claim, F.lit('"')), F.lit("'"))
    return collapse_whitespace(F.regexp_replace(claim, r"\A1\.", ""))


def extract_claim(text: Column) -> Column:
    """The claim of a text without a model: its best sentence, tidied; ``""`` if blank."""
    return F.when(is_blank(text), "").otherwise(clean_claim(best_sentence(strip(text))))


def central_claims(frame: DataFrame, text: Column, claim: str = "claim") -> DataFrame:
    """Add the claim of a text as its most central sentence, and its ``centrality``.

    Sentences are linked by the rarer words they share and scored by power iteration, see
    ``functions.centrality``; of equals the most claim-like (:func:`sentence_score`) is taken,
    then the earliest.  Nothing leaves the row.  A blank text has an empty claim and no centrality.
    """
    words = F.transform(
        "_sentences",
        lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(LINKING_WORD), F.lit(0))),
    )
    scored = (
        frame.withColumn("_sentences", split_sentences(strip(text)))
        .withColumn("_words", words)
        .withColumn(
            "_scores",
            central(
                F.transform(F.flatten("_words"), lambda word: F.xxhash64(word)),
                F.transform("_words", lambda held: F.size(held)),
            ),
        )
    )
    ranked = F.transform(
        "_sentences",
        lambda sentence, at: F.struct(
            F.get("_scores", at).alias("centrality"),
            sentence_score(sentence).alias("score"),
            (-at).alias("rank"),
            sentence.alias("sentence"),
        ),
    )
    best = scored.withColumn("_best", F.array_max(ranked))
    return best.withColumns(
        {
            claim: F.when(is_blank(text), "").otherwise(clean_claim(F.col("_best")["sentence"])),
            "centrality": F.when(~is_blank(text), F.col("_best")["centrality"]),
        }
    ).drop("_sentences", "_words", "_scores", "_best")


def claim_list(claim: Column) -> Column:
    """The claim as an array, empty for a blank one."""
    none = F.array().cast("array<string>")
    return F.when(as_text(claim) == "", none).otherwise(F.array(claim))


def claim_input(processed: str = "processed_text", text: str = "text") -> Column:
    """What claim extraction reads: processed text, else raw text, else ``""``."""
    empty = F.lit("")
    return F.coalesce(F.nullif(processed, empty), F.nullif(text, empty), empty)


def choose_claim(processed: DataFrame, mode: str = "extractive") -> DataFrame:
    """Add ``claim`` and, on failure, an entry in ``errors``.

    ``mode="extractive"`` and ``mode="central"`` (which adds ``centrality``) need no model.  ``mode="replies"`` tidies the model
    reply in column ``raw``; where there is none the stripped input is the claim
    and the error says so.  Blank input gives an empty claim either way.
    """
    source = claim_input()
    if mode == "extractive":
        return processed.withColumn("claim", extract_claim(source))
    if mode == "central":
        return central_claims(processed, source)
    failed = ~is_blank(source) & F.col("raw").isNull()
    return processed.withColumns(
        {
            "claim": F.when(is_blank(source), F.lit(""))
            .when(failed, strip(source))
            .otherwise(clean_claim(F.col("raw"))),
            "errors": F.when(
                failed, F.array_append("errors", F.lit(CLAIM_ERROR + "no model reply"))
            ).otherwise(F.col("errors")),
        }
    )


def brevity(frame: DataFrame, text: str, claim: str) -> DataFrame:
    """Counts of non-empty claims and of claims shorter than half of their text."""
    return frame.agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.col(claim) != "").alias("with_claim"),
        F.count_if((F.col(claim) != "") & (F.length(claim) * 2 < F.length(text))).alias("brief"),
    )


