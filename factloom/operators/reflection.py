"""Is the evidence of a claim good enough?  Metrics, reply scores and safeguards.

Metrics are one aggregate with map-side combine.  The rest are rules inside a
row; their order matters and is the order of the steps below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import modeljson as mj
from ..functions.modeljson import Field
from ..functions.phrases import NOTES_PHRASES, singular_sources
from ..functions.text import as_text, is_blank, strip

# --- fixed values -----------------------------------------------------------
DEFAULT_SIMILARITY, DEFAULT_AUTHORITY = 0.5, 0.3
LOW_AUTHORITY, GOOD_AUTHORITY = 0.35, 0.60
LEAST_QUALITY = 0.60
#: Share of similarity and authority in the default quality score.
SIMILARITY_SHARE, AUTHORITY_SHARE = 0.4, 0.6
#: Confidence above which weak sources are overruled, and the caps that apply.
WEAK_SOURCE_DOUBT = 0.50
WEAK_SOURCE_CAP, CONFLICT_CAP, QUALITY_CAP = 0.40, 0.50, 0.45
DEFAULT_DOMAIN = "General"
NO_CLAIM = "No claim was provided."
NO_EVIDENCE = "No evidence was provided. Evidence retrieval is required."
UNPARSED = "Failed to parse valid JSON from LLM."
BROKEN_REPLY = "LLM execution error: the reply is not valid JSON"
DEFAULT_NOTES = "Evidence evaluation completed."
WEAK_SOURCE_NOTES = (
    "Low source credibility detected (max authority: %.2f). "
    "Even if semantic similarity is high, unverified/blog sources are insufficient."
)
CONFLICT_NOTES = " Unresolved contradictions found between retrieved evidence items."
QUALITY_NOTES = (
    " Evidence quality score (%.2f) or source credibility (%.2f) falls below threshold."
)
# ----------------------------------------------------------------------------

METRICS = [
    "evidence_count", "avg_similarity", "avg_authority", "max_authority", "min_authority",
    "low_authority_only", "has_authoritative",
]
#: Fields read from a reply.
REPLY_FIELDS = [
    "decision", "confidence", "notes", "support_score", "source_credibility_score",
    "evidence_quality_score", "claim_supported", "claim_contradicted",
    "evidence_items_contradict_each_other", "contradictions_found",
]
SCORES = ["confidence", "support_score", "source_credibility_score", "evidence_quality_score"]
RESULT = [
    "decision", "is_evidence_sufficient", "contradictions_found", "confidence", "notes",
    "support_score", "source_credibility_score", "evidence_quality_score",
    "claim_supported", "claim_contradicted", "evidence_items_contradict_each_other",
]


def _score(name: str, default: float) -> Column:
    return F.coalesce(F.col(name).try_cast("double"), F.lit(default))


def metric_columns(keep: Column | None = None) -> list[Column]:
    """The metrics as aggregate columns, over the rows where ``keep`` holds."""

    def only(value: Column) -> Column:
        return value if keep is None else F.when(keep, value)

    similarity = only(_score("similarity_score", DEFAULT_SIMILARITY))
    authority = only(_score("authority_score", DEFAULT_AUTHORITY))
    return [
        F.count(similarity).alias("evidence_count"),
        F.round(F.avg(similarity), 4).alias("avg_similarity"),
        F.round(F.avg(authority), 4).alias("avg_authority"),
        F.round(F.max(authority), 4).alias("max_authority"),
        F.round(F.min(authority), 4).alias("min_authority"),
        (F.max(authority) <= LOW_AUTHORITY).alias("low_authority_only"),
        (F.max(authority) >= GOOD_AUTHORITY).alias("has_authoritative"),
    ]


def evidence_metrics(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Count, averages and extremes of the scores, and the two authority flags."""
    return evidence.groupBy(*keys).agg(*metric_columns())


def with_metric_defaults(frame: DataFrame) -> DataFrame:
    """Metrics of rows that found no evidence: zeros, low authority, not authoritative."""
    zeros = {name: F.coalesce(name, F.lit(0.0)) for name in METRICS[1:5]}
    return frame.withColumns(
        {
            "evidence_count": F.coalesce("evidence_count", F.lit(0).cast("bigint")),
            **zeros,
            "low_authority_only": F.coalesce("low_authority_only", F.lit(True)),
            "has_authoritative": F.coalesce("has_authoritative", F.lit(False)),
        }
    )


def domain_or_default(domain: Column) -> Column:
    """``General`` for a missing domain; a blank one is only trimmed."""
    return F.when(as_text(domain) == "", DEFAULT_DOMAIN).otherwise(strip(domain))


def guard(frame: DataFrame) -> DataFrame:
    """Add ``guard``: the fixed note for rows that need no model, else null."""
    return frame.withColumn(
        "guard",
        F.when(is_blank(F.col("claim")), NO_CLAIM).when(
            F.coalesce("evidence_count", F.lit(0)) == 0, NO_EVIDENCE
        ),
    )


def parse_replies(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``doc`` (VARIANT, null if unusable) and ``reply_error`` (null if usable)."""
    mj.accept_repeated_keys(frame)
    sliced = mj.braces_slice(F.col(raw))
    parsed = frame.withColumn("_slice", sliced).withColumn("_doc", mj.parse(F.col("_slice")))
    # A slice starts with a brace, so only its first marks tell whether the object is empty.
    empty = F.col("_doc").isNotNull() & F.col("_slice").rlike(r"\A\{[ \t\r\n]*\}")
    return parsed.withColumns(
        {
            "doc": F.when(F.col("_doc").isNotNull() & ~empty, F.col("_doc")),
            "reply_error": F.when((F.coalesce("_slice", F.lit("")) == "") | empty, UNPARSED).when(
                F.col("_doc").isNull(), BROKEN_REPLY
            ),
        }
    ).drop("_slice", "_doc")


def reply_scores(frame: DataFrame) -> DataFrame:
    """Read decision, booleans, clamped scores and notes from ``doc``, before safeguards."""
    failed = F.col("doc").isNull()
    several = F.col("evidence_count") > 1
    items = several & Field("evidence_items_contradict_each_other").truthy()
    default_quality = (
        F.col("avg_similarity") * SIMILARITY_SHARE + F.col("avg_authority") * AUTHORITY_SHARE
    )

    def score(name: str, default: Column) -> Column:
        read = mj.unit_interval(F.col(f"_{name}_number"))
        return F.when(failed, F.lit(0.0)).otherwise(F.coalesce(read, default))

    decision = F.upper(strip(Field("decision").text("NO")))
    read = mj.with_fields(frame, "doc", REPLY_FIELDS)
    # Numbers stand in columns of their own, so each is read once however often a rule asks.
    numbers = {f"_{name}_number": Field(name).number() for name in SCORES}
    scored = read.withColumns(numbers).withColumns(
        {
            "decision": F.when(decision == "YES", "YES").otherwise("NO"),
            "claim_supported": Field("claim_supported").truthy(),
            "claim_contradicted": Field("claim_contradicted").truthy(),
            "evidence_items_contradict_each_other": items,
            "contradictions_found": items | (several & Field("contradictions_found").truthy()),
            "support_score": score("support_score", F.lit(0.0)),
            "source_credibility_score": score("source_credibility_score", F.col("avg_authority")),
            "evidence_quality_score": score("evidence_quality_score", default_quality),
            "confidence": score("confidence", F.lit(0.0)),
            "notes": singular_sources(
                F.coalesce("reply_error", Field("notes").text(DEFAULT_NOTES)),
                F.col("evidence_count"),
                NOTES_PHRASES,
            ),
        }
    )
    return mj.without_fields(scored, REPLY_FIELDS).drop(*numbers)


def _two_digits(name: str) -> Column:
    return F.round(name, 2)


def safeguards(frame: DataFrame) -> DataFrame:
    """Overrule replies that the evidence does not carry; then round.

    In this order: weak sources, conflicting items, quality of what is still YES.
    """
    low = F.col("low_authority_only")
    overruled = low & ((F.col("decision") == "YES") | (F.col("confidence") > WEAK_SOURCE_DOUBT))
    weak = frame.withColumns(
        {
            "source_credibility_score": F.when(
                low, F.least("source_credibility_score", "max_authority")
            ).otherwise(F.col("source_credibility_score")),
            "evidence_quality_score": F.when(
                low, F.least("evidence_quality_score", "max_authority")
            ).otherwise(F.col("evidence_quality_score")),
            "decision": F.when(overruled, "NO").otherwise(F.col("decision")),
            "confidence": F.when(
                overruled, F.least("confidence", F.lit(WEAK_SOURCE_CAP))
            ).otherwise(F.col("confidence")),
            "notes": F.when(
                overruled, F.format_string(WEAK_SOURCE_NOTES, _two_digits("max_authority"))
            ).otherwise(F.col("notes")),
        }
    )
    conflict = F.col("evidence_items_contradict_each_other")
    settled = weak.withColumns(
        {
            "decision": F.when(conflict, "NO").otherwise(F.col("decision")),
            "confidence": F.when(conflict, F.least("confidence", F.lit(CONFLICT_CAP))).otherwise(
                F.col("confidence")
            ),
            "notes": F.when(conflict, F.concat("notes", F.lit(CONFLICT_NOTES))).otherwise(
                F.col("notes")
            ),
        }
    )
    poor = (F.col("decision") == "YES") & (
        (F.col("evidence_quality_score") < LEAST_QUALITY)
        | (F.col("source_credibility_score") < LOW_AUTHORITY)
    )
    judged = settled.withColumns(
        {
            "decision": F.when(poor, "NO").otherwise(F.col("decision")),
            "confidence": F.when(poor, F.least("confidence", F.lit(QUALITY_CAP))).otherwise(
                F.col("confidence")
            ),
            "notes": F.when(
                poor,
                F.concat(
                    "notes",
                    F.format_string(
                        QUALITY_NOTES,
                        _two_digits("evidence_quality_score"),
                        _two_digits("source_credibility_score"),
                    ),
                ),
            ).otherwise(F.col("notes")),
        }
    )
    return judged.withColumns(
        {
            **{name: _two_digits(name) for name in SCORES},
            "is_evidence_sufficient": F.col("decision") == "YES",
        }
    )


def reflect(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """The whole reflection step for rows with ``claim``, metrics and a raw reply.

    Metrics may be null where no evidence was found.  Guarded rows get their fixed
    result whatever the reply says.
    """
    guarded = with_metric_defaults(guard(frame))
    scored = safeguards(reply_scores(parse_replies(guarded, raw)))
    free = F.col("guard").isNull()

    def unless_guarded(name: str, fixed: Column) -> Column:
        return F.when(free, F.col(name)).otherwise(fixed)

    booleans = [name for name in RESULT if scored.schema[name].dataType.simpleString() == "boolean"]
    numbers = [name for name in RESULT if scored.schema[name].dataType.simpleString() == "double"]
    return scored.withColumns(
        {
            "decision": unless_guarded("decision", F.lit("NO")),
            "notes": unless_guarded("notes", F.col("guard")),
            **{name: unless_guarded(name, F.lit(False)) for name in booleans},
            **{name: unless_guarded(name, F.lit(0.0)) for name in numbers},
        }
    ).drop("guard", "doc", "reply_error")
