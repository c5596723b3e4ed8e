"""From claims, evidence and recorded replies to verified, explained verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import explanations
from ..operators.attempts import given_up, reflect_until_stop
from ..operators.groups import GROUP_ROW_LIMIT
from ..operators.reflection import NO_EVIDENCE
from ..operators.reflection import RESULT as REFLECTION
from ..operators.verdicts import (
    final_evidence, first_parseable, key_evidence, parse_verdicts, verdict_inputs,
    with_key_evidence, without_verdict,
)
from ..session import ensure_checkpoint_dir
from ..sources.replies import attach_replies

#: Reasons of rejects.
NO_VERDICT = "No try of the verdict held a JSON object."
NO_EXPLANATION = "No explanation was recorded."
EXPLANATION = ["explanation", "evidence_summary", "source_analysis", "reasoning", "confidence"]


def decide(claims: DataFrame, evidence: DataFrame, replies: DataFrame) -> DataFrame:
    """Stopped claims with their reflection and verdict, one row per claim.

    Evidence, replies and claims are each reduced to one row per claim and joined
    on the claim, so all joins share one partitioning.  Claims that were given up
    or have no usable verdict are not in it; see ``given_up`` and
    ``without_verdict``.
    """
    stopped = verdict_inputs(reflect_until_stop(claims, evidence, replies, ["claim", "domain"]))
    reflected = stopped.withColumnsRenamed({name: f"reflection_{name}" for name in REFLECTION})
    return parse_verdicts(reflected.join(first_parseable(replies), "claim_id"))


def verification_rejects(
    claims: DataFrame, evidence: DataFrame, replies: DataFrame
) -> DataFrame:
    """(claim_id, stage, reason) of every claim that is not in the report.

    With it each claim is accounted for: it was given up without evidence, or no try gave
    a verdict, or its explanation is missing or unusable.
    """
    chosen = first_parseable(replies)
    none = given_up(claims, evidence).select("claim_id")
    tried = claims.select("claim_id").join(none, "claim_id", "left_anti")
    undecided = without_verdict(tried, chosen)
    asked = attach_replies(
        tried.join(chosen.select("claim_id"), "claim_id", "left_semi"),
        replies, "explanation", ["claim_id"],
    )
    unexplained = explanations.parse_replies(asked).filter(F.col("doc").isNull())

    def rejected(rows: DataFrame, stage: str, reason: Column) -> DataFrame:
        return rows.select("claim_id", F.lit(stage).alias("stage"), reason.alias("reason"))

    reason = F.when(F.col("raw").isNull(), NO_EXPLANATION).otherwise(F.col("reply_error"))
    return (
        rejected(none, "evidence", F.lit(NO_EVIDENCE))
        .unionByName(rejected(undecided, "verdict", F.lit(NO_VERDICT)))
        .unionByName(rejected(unexplained, "explanation", reason))
    )


def explanation_docs(replies: DataFrame) -> DataFrame:
    """Per claim (claim_id, doc, usable) of its earliest recorded explanation.

    Replies are parsed before one is chosen: a test of the parsed reply can then not move
    below the choice, where it would parse each reply once more for every mention of it.
    ``usable`` stands by itself, for steps that need no more.
    """
    said = explanations.parse_replies(
        replies.filter(F.col("stage") == "explanation").select("claim_id", "try_no", "raw")
    )
    return said.withColumn("usable", F.col("doc").isNotNull()).groupBy("claim_id").agg(
        F.min_by("doc", "try_no").alias("doc"), F.min_by("usable", "try_no").alias("usable")
    )


def _report_and_citations(
    claims: DataFrame, evidence: DataFrame, replies: DataFrame, order: list[str], row_limit: int
) -> tuple[DataFrame, DataFrame]:
    """The flat report, and the citations of all decided claims."""
    ensure_checkpoint_dir(claims.sparkSession)
    decided = decide(claims, evidence, replies).checkpoint()
    asked = decided.join(explanation_docs(replies).drop("usable"), "claim_id")
    explained = explanations.validate(asked)
    report = explained.select(
        "claim_id", "claim", "domain", "attempt_count", "maximum_attempts_reached",
        *[f"reflection_{name}" for name in REFLECTION],
        "final_verdict", "confidence_score", "trust_score", "reasoning_summary",
        *[F.col(name).alias(f"explanation_{name}") for name in EXPLANATION],
    )
    return report, key_evidence(
        decided, final_evidence(evidence, decided), order, row_limit, measured=evidence
    )


def verification_tables(
    claims: DataFrame,
    evidence: DataFrame,
    replies: DataFrame,
    order: list[str],
    row_limit: int = GROUP_ROW_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """(report, citations): one row per claim (claim_id, claim, domain) that made it through
    all stages, and its key evidence as flat rows (claim_id, item_no, item).

    A claim may cite any amount of evidence, since nothing is nested.  ``order`` says how
    evidence is ordered within a claim.  The decided claims are read by several later
    steps, so they are checkpointed once: a table of one row per claim, which also shields
    those steps from a lost executor.
    """
    report, cited = _report_and_citations(claims, evidence, replies, order, row_limit)
    # Only decided claims have citations, so of these the report has those with an explanation.
    explained = explanation_docs(replies).filter("usable").select("claim_id")
    return report, cited.join(explained, "claim_id", "left_semi")


def verification_report(
    claims: DataFrame,
    evidence: DataFrame,
    replies: DataFrame,
    order: list[str],
    row_limit: int = GROUP_ROW_LIMIT,
) -> DataFrame:
    """The report with the citations of a claim nested as ``key_evidence_used``.

    For claims with so much evidence that one row cannot hold it, take
    :func:`verification_tables`.
    """
    return with_key_evidence(*_report_and_citations(claims, evidence, replies, order, row_limit))
