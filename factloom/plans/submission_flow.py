"""From raw submissions to one claim and its domain per submission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.claims import choose_claim
from ..operators.domains import detect_domain
from ..operators.groups import GROUP_ROW_LIMIT
from ..operators.ocr import documents, documents_for
from ..operators.segments import aggregate, named_images, side_by_side
from ..sources.replies import attach_replies
from ..sources.submissions import with_fallback


def process_submissions(
    submissions: DataFrame,
    images: DataFrame,
    blocks: DataFrame,
    memory: DataFrame,
    row_limit: int = GROUP_ROW_LIMIT,
) -> DataFrame:
    """Processed rows of all submissions; those that cannot be processed get fallback rows.

    ``images`` lists existing images, ``blocks`` the text blocks recognised in them
    and ``memory`` known translations.  Only images that a submission names are worked on.
    """
    named = named_images(submissions)
    wanted = blocks.join(named, "image_id", "left_semi")
    recognised = documents_for(
        images.join(named, "image_id", "left_semi"), documents(wanted, row_limit)
    )
    return with_fallback(aggregate(side_by_side(submissions, recognised, memory)))


def claims_and_domains(
    processed: DataFrame, replies: DataFrame | None = None
) -> DataFrame:
    """Add ``claim``, ``domain``, ``confidence`` and ``reason`` to processed submissions.

    Without replies the extractive claim and the lexicon are used.  With replies,
    stages ``claim`` and ``domain`` are looked up by ``claim_id``, which is the
    submission's id.
    """
    if replies is None:
        return detect_domain(choose_claim(processed, "extractive"), "lexicon")
    keyed = processed.withColumn("claim_id", F.col("submission_id"))
    claimed = choose_claim(attach_replies(keyed, replies, "claim", ["claim_id"]), "replies")
    asked = attach_replies(claimed.drop("raw"), replies, "domain", ["claim_id"])
    return detect_domain(asked, "replies").drop("raw", "claim_id")
