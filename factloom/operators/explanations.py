"""Validation of explanation replies against the verdict they explain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import modeljson as mj
from ..functions.modeljson import Field
from ..functions.phrases import VERDICT_PHRASES, singular_sources
from .verdicts import UNVERIFIED, verdict_name

# --- fixed values -----------------------------------------------------------
DEFAULT_CONFIDENCE = 0.85
DEFAULT_VERDICT_SCORE = 85
DEFAULT_SUMMARY = "Summary provided."
ABSENT = "N/A"
TEXTS = ["explanation", "source_analysis", "reasoning"]
NOT_JSON = "XAI Agent did not return valid JSON."
NOT_OBJECT = "XAI output is not a JSON object."
# ----------------------------------------------------------------------------

#: Fields read from a reply.
REPLY_FIELDS = ["final_verdict", "confidence", "evidence_summary", *TEXTS]


def parse_replies(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``doc`` (VARIANT object or null) and ``reply_error`` (null if usable).

    The whole reply is tried first; only if it is no JSON at all do the braces count.
    """
    mj.accept_repeated_keys(frame)
    body = frame.withColumn("_body", mj.without_fences(F.col(raw)))
    whole = body.withColumn("_whole", mj.parse(F.col("_body")))
    parsed = whole.withColumn(
        "_doc", F.coalesce("_whole", mj.parse(mj.braces_slice(F.col("_body"))))
    )
    usable = mj.is_object(F.col("_doc"))
    return parsed.withColumns(
        {
            "doc": F.when(usable, F.col("_doc")),
            "reply_error": F.when(F.col("_doc").isNull(), NOT_JSON).when(~usable, NOT_OBJECT),
        }
    ).drop("_body", "_whole", "_doc")


def share_of_score(score: Column) -> Column:
    """A verdict score as a share of one: above 1 it is a percentage."""
    return F.round(F.when(score > 1, score / 100.0).otherwise(score), 2)


def baseline_confidence(score: Column) -> Column:
    """The confidence a prompt suggests, from the verdict's score."""
    return share_of_score(F.coalesce(score.try_cast("double"), F.lit(float(DEFAULT_VERDICT_SCORE))))


def repaired_confidence(field: Field, score: Column) -> Column:
    """The reply's confidence, or the verdict's where it is missing, unusable or zero."""
    number = field.number()
    own = F.round(
        F.when((number > 1) & (number <= 100), number / 100.0).when(
            number.between(0.0, 1.0), number
        ),
        2,
    )
    theirs = share_of_score(score.cast("double"))
    lacking = F.coalesce(own == 0, F.lit(True))
    return mj.unit_interval(
        F.when(lacking & (theirs > 0), theirs).otherwise(
            F.coalesce(own, F.lit(DEFAULT_CONFIDENCE))
        )
    )


def validate(frame: DataFrame) -> DataFrame:
    """Explanation columns from ``doc``, for rows that carry their verdict.

    Needs ``final_verdict`` and ``confidence_score`` of the verdict (null if there
    is none) and ``evidence_count``.  The verdict overrides whatever the reply says.
    An evidence summary that is no list is wrapped, and an empty one gets a default.
    """
    verdict, confidence, summary = (
        Field(name) for name in ("final_verdict", "confidence", "evidence_summary")
    )
    wrapped = F.when(summary.truthy(), summary.text(DEFAULT_SUMMARY)).otherwise(DEFAULT_SUMMARY)
    texts = {
        name: singular_sources(
            Field(name).text(ABSENT), F.col("evidence_count"), VERDICT_PHRASES
        )
        for name in TEXTS
    }
    read = mj.with_fields(frame.filter(F.col("doc").isNotNull()), "doc", REPLY_FIELDS)
    checked = read.withColumns(
        {
            "final_verdict": F.coalesce("final_verdict", verdict_name(verdict.text(UNVERIFIED))),
            "confidence": repaired_confidence(confidence, F.col("confidence_score")),
            "evidence_summary": F.when(
                summary.is_list(), mj.list_item("doc", "evidence_summary")
            ).otherwise(F.array(wrapped)),
            **texts,
        }
    )
    return mj.without_fields(checked, REPLY_FIELDS).drop("doc", "reply_error")

