"""Every registered query: a name and a function (spark, folder) -> DataFrame.

Queries run over whole tables.  Arrays are shown as joined text so that results
compare as plain values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import modeljson as mj
from ..functions import text as tx
from ..functions.language import detect_language, latin_count, telugu_count
from ..functions.phrases import NOTES_PHRASES, VERDICT_PHRASES, singular_sources
from ..functions.sentences import protect_urls, restore_urls, split_sentences, urls_in
from ..operators import (
    attempts, claims, cleaning, domain_weights, domains, explanations, ocr, prompts, reflection, retrieval, segments,
    translation, verdicts,
)
from ..operators.groups import within_limits
from ..sources import evidence as ev
from ..sources import submissions as sub
from ..session import ensure_checkpoint_dir
from ..sources.replies import attach_replies
from . import submission_flow, verification_flow
from .inputs import Inputs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

ARRIVAL = ["arrival"]
#: Characters of a prompt part in these queries; small, so that prompts of the given tables have several.
PART = 300


def query(build: Callable[[Inputs], DataFrame], name: str | None = None) -> Query:
    """Register a function of :class:`Inputs` under its own name, or the given one."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Inputs(spark, folder))

    run.__name__, run.__doc__ = name or build.__name__, build.__doc__
    run.build = build
    QUERIES[run.__name__] = run
    return run


def query_named(name: str) -> Callable[[Callable[[Inputs], DataFrame]], Query]:
    """For names that an operator module or function in this file has already."""
    return lambda build: query(build, name)


def shown(name: str, separator: str = ", ") -> Column:
    return F.array_join(name, separator).alias(name)


# --- submissions ---------------------------------------------------------------


@query
def submissions_profile(i: Inputs) -> DataFrame:
    present = sub.with_presence(i.submissions)
    return present.groupBy("had_text", "had_image").agg(F.count(F.lit(1)).alias("submissions"))


@query
def submissions_quarantine(i: Inputs) -> DataFrame:
    checked = sub.reject_reason(i.submissions, i.images)
    return checked.filter(F.col("reason").isNotNull()).select("submission_id", "reason")


def _processed(i: Inputs) -> DataFrame:
    return submission_flow.process_submissions(
        i.submissions, i.images, i.ocr_blocks, i.translation_memory
    )


@query
def submissions_fallback(i: Inputs) -> DataFrame:
    return _processed(i).filter(F.size("errors") > 0).select(
        "submission_id", "processed_text", "pre_translation_text", "original_language",
        "language_confidence", "was_translated", "had_text", "had_image",
        shown("quality_flags"), shown("errors"),
    )


# --- normalisation ----------------------------------------------------------------


def _noisy(i: Inputs, text: Column) -> DataFrame:
    return i.noisy_documents.select("doc_id", text.alias("text"))


@query
def normalize_text(i: Inputs) -> DataFrame:
    return _noisy(i, tx.normalize_text(F.col("text")))


@query
def normalize_nfc(i: Inputs) -> DataFrame:
    return _noisy(i, tx.compose_unicode(F.col("text")))


@query
def normalize_numeric(i: Inputs) -> DataFrame:
    return _noisy(i, tx.join_numbers(F.col("text")))


@query
def normalize_punct(i: Inputs) -> DataFrame:
    return _noisy(i, tx.calm_punctuation(F.col("text")))


# --- cleaning -------------------------------------------------------------------------


@query
def clean_control(i: Inputs) -> DataFrame:
    return _noisy(i, tx.drop_control_characters(F.col("text")))


@query
def clean_tokens(i: Inputs) -> DataFrame:
    return _noisy(i, tx.drop_noise_tokens(F.col("text")))


@query
def clean_lines(i: Inputs) -> DataFrame:
    return _noisy(i, tx.clean_text(F.col("text")))


@query
def dedupe_lines(i: Inputs) -> DataFrame:
    return _noisy(i, tx.drop_repeated_lines(tx.tidy_lines(F.col("text"))))


@query
def dedupe_lines_window(i: Inputs) -> DataFrame:
    return cleaning.kept_lines(i.noisy_documents, "doc_id", "text")


@query
def dedupe_lines_variant(i: Inputs) -> DataFrame:
    return _noisy(i, tx.dedupe_lines(F.col("text")))


@query
def clean_flags(i: Inputs) -> DataFrame:
    cleaned = cleaning.clean(i.noisy_documents, "text")
    return cleaned.select("doc_id", "cleaned_text", shown("quality_flags"))


@query
def quality_flag_counts(i: Inputs) -> DataFrame:
    return cleaning.flag_counts(cleaning.clean(i.noisy_documents, "text"))


# --- language and sentences -------------------------------------------------------------


@query
def script_counts(i: Inputs) -> DataFrame:
    text = F.col("text")
    return i.noisy_documents.select(
        "doc_id", telugu_count(text).alias("telugu"), latin_count(text).alias("latin")
    )


@query
def lang_detect(i: Inputs) -> DataFrame:
    found = detect_language(F.col("text"))
    return i.short_posts.select("post_id", found["language"].alias("language"),
                                found["confidence"].alias("confidence"))


@query
def lang_profile(i: Inputs) -> DataFrame:
    """Language per source with subtotals; the flag columns tell the levels apart."""
    found = segments.with_language(i.noisy_documents, "text")
    return (
        found.rollup("source", "detected_language")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count(F.lit(1)).alias("documents"),
            F.round(F.avg("language_confidence"), 4).alias("confidence"),
        )
        .withColumns(
            {
                "source": F.coalesce("source", F.lit("all")),
                "detected_language": F.coalesce("detected_language", F.lit("all")),
            }
        )
    )


@query_named("split_sentences")
def sentence_rows(i: Inputs) -> DataFrame:
    rows = translation.sentences_of(i.noisy_documents, ["doc_id"], "text")
    return rows.select("doc_id", "sentence_no", "sentence")


@query
def telugu_sentences(i: Inputs) -> DataFrame:
    rows = translation.sentences_of(i.noisy_documents, ["doc_id"], "text")
    return rows.filter("is_telugu").drop("is_telugu")


@query_named("protect_urls")
def masked_urls(i: Inputs) -> DataFrame:
    text = F.concat(F.lit("See "), F.col("url"), F.lit(", WWW.a.example or "), F.col("url"),
                    F.lit(" in "), F.col("html"))
    masked = i.pages.select("page_id", text.alias("text")).withColumns(
        {"masked": protect_urls(F.col("text")), "urls": urls_in(F.col("text"))}
    )
    return masked.select(
        "page_id", "masked", shown("urls", " "),
        (restore_urls(F.col("masked"), F.col("urls")) == F.col("text")).alias("restored"),
    )


@query
def translate_segments(i: Inputs) -> DataFrame:
    done = translation.translate(i.noisy_documents, ["doc_id"], "text", i.translation_memory)
    return done.select("doc_id", "translated_text")


@query
def translation_metadata(i: Inputs) -> DataFrame:
    counts = translation.translation_counts(F.col("sentences"))
    split = i.noisy_documents.select("doc_id", split_sentences(F.col("text")).alias("sentences"))
    return split.select("doc_id", *[column.alias(name) for name, column in counts.items()])


# --- text blocks of images -----------------------------------------------------------------


@query
def ocr_geometry(i: Inputs) -> DataFrame:
    return ocr.geometry(i.ocr_blocks).drop("box", "confidence")


@query
def ocr_lines(i: Inputs) -> DataFrame:
    return ocr.lines(i.ocr_blocks).select(
        "image_id", "block_no", F.col("line_no").cast("bigint").alias("line_no")
    )


@query
def ocr_reading_order(i: Inputs) -> DataFrame:
    return ocr.reading_order(i.ocr_blocks).select(
        "image_id", "block_no", "reading_order", "text", "confidence"
    )


@query
def ocr_documents(i: Inputs) -> DataFrame:
    found = ocr.documents(i.ocr_blocks)
    return found.select(
        "image_id", "text", "average_confidence", "block_count", shown("quality_flags")
    )


@query
def ocr_empty(i: Inputs) -> DataFrame:
    found = ocr.documents_for(i.images, ocr.documents(i.ocr_blocks))
    return found.filter(F.col("text") == "").select(
        "image_id", "average_confidence", "block_count", shown("quality_flags")
    )


# --- segments ------------------------------------------------------------------------------


def _sides(i: Inputs) -> DataFrame:
    recognised = ocr.documents_for(i.images, ocr.documents(i.ocr_blocks))
    return segments.side_by_side(i.submissions, recognised, i.translation_memory)


@query_named("segments")
def segment_rows(i: Inputs) -> DataFrame:
    rows = segments.segment_rows(_sides(i).filter(F.col("reason").isNull()))
    return rows.withColumn("quality_flags", shown("quality_flags"))


@query
def segment_blocks(i: Inputs) -> DataFrame:
    """Image provenance of the OCR segments."""
    return segments.segment_blocks(i.submissions, i.images, i.ocr_blocks)


@query
def segment_language_merge(i: Inputs) -> DataFrame:
    merged = segments.with_merged_language(_sides(i).filter(F.col("reason").isNull()))
    return merged.select("submission_id", "original_language", "language_confidence")


@query
def segment_aggregate(i: Inputs) -> DataFrame:
    return _processed(i).filter(F.size("errors") == 0).select(
        "submission_id", "processed_text", "pre_translation_text", "original_language",
        "language_confidence", "was_translated", "had_text", "had_image",
        F.size("segments").alias("segment_count"), "ocr_confidence", shown("quality_flags"),
        "translated_segments",
    )


# --- claims and domains ---------------------------------------------------------------------


@query
def claim_input(i: Inputs) -> DataFrame:
    given = i.submissions.select(
        "submission_id", "text", tx.normalize_text(F.col("text")).alias("processed_text")
    )
    return given.select("submission_id", claims.claim_input().alias("claim_input"))


@query
def claim_extract(i: Inputs) -> DataFrame:
    return i.noisy_documents.select("doc_id", claims.extract_claim(F.col("text")).alias("claim"))


@query
def claim_central(i: Inputs) -> DataFrame:
    made = claims.central_claims(i.noisy_documents.select("doc_id", "text"), F.col("text"))
    return made.select("doc_id", "claim", "centrality")


@query
def claim_clean(i: Inputs) -> DataFrame:
    return i.claim_replies.select("claim_id", claims.clean_claim(F.col("raw")).alias("claim"))


@query_named("claim_list")
def claim_items(i: Inputs) -> DataFrame:
    listed = i.claims.select("claim_id", claims.claim_list(tx.strip(F.col("claim"))).alias("list"))
    return listed.select("claim_id", F.explode("list").alias("claim"))


@query
def claim_quality(i: Inputs) -> DataFrame:
    made = i.noisy_documents.select("text", claims.extract_claim(F.col("text")).alias("claim"))
    return claims.brevity(made, "text", "claim")


def _claimed(i: Inputs) -> DataFrame:
    source = i.submissions.select(
        F.col("submission_id").alias("claim_id"),
        "text",
        tx.normalize_text(F.col("text")).alias("processed_text"),
        F.array().cast("array<string>").alias("errors"),
    )
    asked = attach_replies(source, i.claim_replies, "claim", ["claim_id"])
    return claims.choose_claim(asked, "replies").drop("raw")


@query
def claim_stage(i: Inputs) -> DataFrame:
    return _claimed(i).select("claim_id", "claim", shown("errors"))


@query
def domain_lexicon(i: Inputs) -> DataFrame:
    scored = domains.classify(i.claims.select("claim_id", "claim"), "claim")
    return scored.select("claim_id", "domain", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "reason")


@query
def domain_eval(i: Inputs) -> DataFrame:
    labelled = i.claims.select(
        "claim", F.coalesce(tx.strip(F.col("domain")), F.lit("none")).alias("expected_domain")
    )
    return domains.confusion(domains.classify(labelled, "claim"))


def _learned(i: Inputs) -> DataFrame:
    """Domains by weights from four fifths of the labelled claims; the rest are held out."""
    claims = i.claims.select(
        "claim_id", "claim", tx.strip(F.col("domain")).alias("expected_domain"), (F.col("claim_id") % 5 == 0).alias("held_out")
    )
    taught = claims.filter(~F.col("held_out"))
    found = domain_weights.classify(claims, *domain_weights.word_weights(taught, label="expected_domain"))
    return claims.join(found, "claim_id")


@query
def domain_learned(i: Inputs) -> DataFrame:
    return _learned(i).select("claim_id", "held_out", "domain", F.round("confidence", 4).alias("confidence"))


@query
def domain_learned_eval(i: Inputs) -> DataFrame:
    labelled = F.col("held_out") & F.col("expected_domain").isin(domains.DOMAINS)
    return domain_weights.quality(_learned(i).filter(labelled))


@query
def response_json(i: Inputs) -> DataFrame:
    return i.domain_replies.select("claim_id", mj.fenced_or_braced(F.col("raw")).alias("body"))


@query
def domain_parse(i: Inputs) -> DataFrame:
    return i.domain_replies.select(
        "claim_id", mj.is_object(mj.parse(mj.fenced_or_braced(F.col("raw")))).alias("is_object")
    )


@query
def domain_validate(i: Inputs) -> DataFrame:
    checked = domains.parse_replies(i.domain_replies)
    return checked.select("claim_id", "domain", "confidence", "reason", "status")


@query
def response_quality(i: Inputs) -> DataFrame:
    return domains.status_counts(domains.parse_replies(i.domain_replies))


@query
def domain_stage(i: Inputs) -> DataFrame:
    asked = attach_replies(
        _claimed(i).withColumn("claim", F.when(F.col("claim_id") % 8 == 5, "").otherwise(F.col("claim"))),
        i.domain_replies, "domain", ["claim_id"],
    )
    done = domains.detect_domain(asked, "replies")
    return done.select("claim_id", "domain", "confidence", "reason", shown("errors"))


# --- evidence and reflection ---------------------------------------------------------------------


@query
def evidence_load(i: Inputs) -> DataFrame:
    loaded = ev.with_defaults(ev.with_numbered_ids(i.evidence, ARRIVAL))
    return loaded.select(
        "claim_id", "arrival", "evidence_id", "chunk_id", "document_id", "title",
        "retrieval_method", F.col("retrieved_date").isNotNull().alias("dated"),
        F.col("metadata")["origin"].alias("origin"), "publication_date",
    )


@query
def evidence_defaults(i: Inputs) -> DataFrame:
    """Ids by content where a row has none, and dates of now where it has none."""
    filled = ev.with_defaults(i.evidence)
    given = F.when(F.col("retrieved_date") < F.lit("2025-01-01").cast("timestamp"), F.col("retrieved_date"))
    return filled.select(
        "claim_id", "arrival", "evidence_id", "retrieval_method", given.alias("known_date"),
    )


@query
def evidence_quarantine(i: Inputs) -> DataFrame:
    _, broken = ev.split_valid(i.evidence)
    return broken.select("claim_id", "arrival", shown("violations"))


@query
def evidence_coerce(i: Inputs) -> DataFrame:
    """Arrays of keys show what an object holds beyond the known fields."""
    coerced = ev.coerce_loose(i.loose_evidence, "raw").drop("raw")
    entries = F.transform(
        F.sort_array(F.map_keys("other")),
        lambda key: F.concat(key, F.lit("="), F.coalesce(F.col("other")[key], F.lit("null"))),
    )
    return coerced.withColumn("other", F.coalesce(F.array_join(entries, ", "), F.lit("")))


@query
def evidence_authority(i: Inputs) -> DataFrame:
    cited = i.documents.select(
        "doc_id", "source",
        F.when(F.col("doc_id") % 3 == 0, F.lit(0.5)).alias("authority_score"),
    )
    filled = ev.with_source_authority(cited, i.source_authority)
    return filled.select("doc_id", "source", F.round("authority_score", 6).alias("authority_score"))


@query
def evidence_metrics(i: Inputs) -> DataFrame:
    return reflection.evidence_metrics(i.evidence, ["claim_id", "attempt_no"])


@query
def reflection_guards(i: Inputs) -> DataFrame:
    metrics = reflection.evidence_metrics(i.evidence, ["claim_id"])
    guarded = reflection.guard(i.claims.join(metrics, "claim_id", "left"))
    ready = reflection.with_metric_defaults(guarded)
    return ready.select(
        "claim_id",
        F.coalesce("guard", F.lit("")).alias("guard"),
        reflection.domain_or_default(F.col("domain")).alias("domain"),
        "evidence_count", "avg_similarity", "low_authority_only", "has_authoritative",
    )


@query
def reflection_parse(i: Inputs) -> DataFrame:
    parsed = reflection.parse_replies(i.reflection_replies)
    return parsed.select(
        "claim_id", "attempt_no", F.col("doc").isNotNull().alias("usable"),
        F.coalesce("reply_error", F.lit("")).alias("reply_error"),
    )


def _scored(i: Inputs) -> DataFrame:
    metrics = reflection.evidence_metrics(i.evidence, ["claim_id", "attempt_no"])
    asked = i.reflection_replies.join(metrics, ["claim_id", "attempt_no"])
    return reflection.reply_scores(reflection.parse_replies(asked))


_SCORES = [
    "support_score", "source_credibility_score", "evidence_quality_score", "confidence",
]
_SIGNS = [
    "claim_supported", "claim_contradicted", "evidence_items_contradict_each_other",
    "contradictions_found",
]


@query
def reflection_scores(i: Inputs) -> DataFrame:
    scores = [F.round(name, 6).alias(name) for name in _SCORES]
    return _scored(i).select("claim_id", "attempt_no", "decision", *scores, *_SIGNS)


@query
def notes_rewrite(i: Inputs) -> DataFrame:
    text = F.concat(F.lit("Multiple sources, "), F.col("text"), F.lit(" SOURCES AGREE; sources contradict each other"))
    count = F.col("doc_id") % 3
    return i.documents.select(
        "doc_id", singular_sources(text, count, NOTES_PHRASES).alias("notes")
    )


@query
def reflection_safeguards(i: Inputs) -> DataFrame:
    judged = reflection.safeguards(_scored(i))
    return judged.select("claim_id", "attempt_no", *reflection.RESULT)


@query
def attempt_grid(i: Inputs) -> DataFrame:
    wide = attempts.attempt_metrics(i.evidence)
    counts = [
        F.coalesce(F.col(f"attempt_{n}.evidence_count"), F.lit(0).cast("bigint")).alias(f"items_{n}")
        for n in (1, 2, 3)
    ]
    return wide.select("claim_id", *counts)


@query
def attempt_carry(i: Inputs) -> DataFrame:
    rows = attempts.carried_attempts(i.claims.select("claim_id"), i.evidence)
    return rows.select(
        "claim_id", "attempt_no", "evidence_attempt", "evidence_count", "avg_authority"
    )


@query
def attempt_aborted(i: Inputs) -> DataFrame:
    return attempts.given_up(i.claims, i.evidence).select("claim_id")


def _stopped(i: Inputs) -> DataFrame:
    return attempts.reflect_until_stop(i.claims, i.evidence, i.replies, ["claim", "domain"])


def _stopped_once(i: Inputs) -> DataFrame:
    """The stopped claims, computed once for the steps of a query that read them."""
    stopped = _stopped(i)
    ensure_checkpoint_dir(stopped.sparkSession)
    return stopped.checkpoint()


@query
def attempt_stop(i: Inputs) -> DataFrame:
    """The flagship: evidence metrics, reflection with safeguards, and the stop rule."""
    return _stopped(i).select(
        "claim_id", "attempt_count", "evidence_attempt", "decision", "confidence",
        "maximum_attempts_reached", "evidence_count", "notes",
    )


# --- verdicts and explanations ------------------------------------------------------------------


@query
def verdict_inputs(i: Inputs) -> DataFrame:
    checked = verdicts.missing_inputs(verdicts.verdict_inputs(_stopped(i)))
    return checked.select(
        "claim_id", "attempt_count", "evidence_count", "original_language", "was_translated",
        F.coalesce("reason", F.lit("")).alias("reason"),
    )


@query
def verdict_retry(i: Inputs) -> DataFrame:
    """Chosen try per claim, 0 where every try failed."""
    chosen = verdicts.first_parseable(i.verdict_replies)
    failed = verdicts.without_verdict(i.claims, chosen)
    return chosen.select("claim_id", "try_no").unionByName(
        failed.select("claim_id", F.lit(0).alias("try_no"))
    )


def _verdicts(i: Inputs) -> DataFrame:
    counts = i.evidence.groupBy("claim_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    chosen = verdicts.first_parseable(i.verdict_replies).join(counts, "claim_id", "left")
    return verdicts.parse_verdicts(chosen.fillna(0, ["evidence_count"]))


@query
def verdict_parse(i: Inputs) -> DataFrame:
    return _verdicts(i).select(
        "claim_id", "try_no", "final_verdict", "reasoning_summary", shown("items", "|")
    )


@query
def verdict_scores(i: Inputs) -> DataFrame:
    return _verdicts(i).select("claim_id", "confidence_score", "trust_score")


@query
def key_evidence(i: Inputs) -> DataFrame:
    return verdicts.key_evidence(_verdicts(i), i.evidence, ARRIVAL)


@query
def reasoning_rewrite(i: Inputs) -> DataFrame:
    text = F.concat(F.lit("Multiple authoritative sources across sources: "), F.col("text"))
    count = F.col("doc_id") % 3
    return i.documents.select(
        "doc_id", singular_sources(text, count, VERDICT_PHRASES).alias("reasoning")
    )


@query
def explain_parse(i: Inputs) -> DataFrame:
    parsed = explanations.parse_replies(i.explanation_replies)
    return parsed.select(
        "claim_id", F.col("doc").isNotNull().alias("usable"),
        F.coalesce("reply_error", F.lit("")).alias("reply_error"),
    )


@query
def explain_validate(i: Inputs) -> DataFrame:
    decided = _verdicts(i).select("claim_id", "final_verdict", "confidence_score", "evidence_count")
    asked = attach_replies(decided, i.explanation_replies, "explanation", ["claim_id"])
    checked = explanations.validate(explanations.parse_replies(asked))
    return checked.select(
        "claim_id", "final_verdict", "explanation", shown("evidence_summary", "|"),
        "source_analysis", "reasoning", "confidence",
    )


@query
def verification_report(i: Inputs) -> DataFrame:
    """All stages end to end, one row per claim that got through."""
    made = verification_flow.verification_report(i.claims, i.evidence, i.replies, ARRIVAL)
    return made.select(
        "claim_id", "attempt_count", "maximum_attempts_reached",
        *[f"reflection_{name}" for name in reflection.RESULT],
        "final_verdict", "confidence_score", "trust_score",
        shown("key_evidence_used", "|"), "explanation_explanation", "explanation_confidence",
    )


@query
def verification_citations(i: Inputs) -> DataFrame:
    """The key evidence of the report's claims, one row per item."""
    return verification_flow.verification_tables(i.claims, i.evidence, i.replies, ARRIVAL)[1]


@query
def verification_rejects(i: Inputs) -> DataFrame:
    return verification_flow.verification_rejects(i.claims, i.evidence, i.replies)


# --- evidence retrieval ---------------------------------------------------------------------------


@query
def retrieve_lexical(i: Inputs) -> DataFrame:
    """Sentences of the benchmark as claims, sentences of all documents as passages."""
    claims = translation.sentences_of(i.benchmark, ["item_id"], "text").withColumnRenamed("sentence_no", "claim_no")
    passages = translation.sentences_of(i.documents, ["doc_id"], "text")
    found = retrieval.retrieve_lexical(
        claims, passages, ["item_id", "claim_no"], ["doc_id", "sentence_no"], text="sentence",
        counts=retrieval.word_counts(i.documents),
    )
    return found.withColumn("likeness", F.round("likeness", 6))


@query
def retrieve_topk(i: Inputs) -> DataFrame:
    """Every hundredth vector as a claim, all others as passages."""
    claims = i.embeddings.filter(F.col("vec_id") % 100 == 0)
    found = retrieval.retrieve_topk(claims, i.embeddings, "vec_id", "vec_id", not_itself=True)
    return found.withColumn("score", F.round("score", 6))


# --- prompt tables ----------------------------------------------------------------------------------


@query
def claim_prompts(i: Inputs) -> DataFrame:
    return prompts.claim_prompts(i.documents, "text").select("doc_id", "prompt")


@query
def domain_prompts(i: Inputs) -> DataFrame:
    return prompts.domain_prompts(i.claims).select("claim_id", "prompt")


@query
def reflection_prompts(i: Inputs) -> DataFrame:
    return prompts.reflection_prompts(i.claims, i.evidence, ARRIVAL)


@query
def verdict_prompts(i: Inputs) -> DataFrame:
    stopped = _stopped_once(i)
    return prompts.verdict_prompts(
        stopped, verdicts.final_evidence(i.evidence, stopped), ARRIVAL, measured=i.evidence,
    )


def _explained(i: Inputs, in_row: Callable[..., DataFrame], flat: Callable[..., DataFrame]) -> DataFrame:
    """Prompts of stopped claims with their final evidence, and verdicts with what these cite.

    Evidence is dealt by claim once and stays in the row of its claim to the prompt (``in_row``);
    claims with more than a row may hold take the flat steps (``flat``).
    """
    weight = F.octet_length("text") + prompts.BLOCK_BYTES
    used = F.col("claim_id").isNotNull() & F.col("attempt_no").between(1, attempts.MAX_ATTEMPTS)
    little, large = within_limits(
        i.evidence.filter(used), ["claim_id"], verdicts.PASSAGE_ROWS, verdicts.PASSAGE_BYTES, weight
    )
    dealt = verdicts.with_passage(little.repartition("claim_id"), ARRIVAL, prompts.json_block(little))
    stopped = attempts.reflect_until_stop(
        i.claims, dealt, i.replies, ["claim", "domain", "passages"], passages=verdicts.passages()
    )
    final = verdicts.final_passages(stopped)
    decided = verdicts.parse_verdicts(
        verdicts.first_parseable(i.verdict_replies).join(final, "claim_id")
    )
    made = in_row(verdicts.with_key_passages(decided))
    if large is None:
        return made
    return made.unionByName(_explained_flat(i, large, flat))


def _explained_flat(i: Inputs, chosen: DataFrame, flat: Callable[..., DataFrame]) -> DataFrame:
    """The same for the ``chosen`` claims, with any amount of evidence."""
    asked, evidence, replies, tries = (
        rows.join(chosen, "claim_id", "left_semi")
        for rows in (i.claims, i.evidence, i.replies, i.verdict_replies)
    )
    stopped = attempts.reflect_until_stop(asked, evidence, replies, ["claim", "domain"])
    ensure_checkpoint_dir(stopped.sparkSession)
    stopped = stopped.checkpoint()
    final = verdicts.final_evidence(evidence, stopped)
    sized = stopped.select("claim_id", "evidence_count")
    decided = verdicts.parse_verdicts(verdicts.first_parseable(tries).join(sized, "claim_id"))
    cited = verdicts.key_evidence(decided, final, ARRIVAL, measured=evidence)
    return flat(stopped, final, verdicts.with_key_evidence(decided, cited), ARRIVAL, measured=evidence)


@query
def explanation_prompts(i: Inputs) -> DataFrame:
    return _explained(i, prompts.explanation_prompts_in_row, prompts.explanation_prompts)


@query
def reflection_blocks(i: Inputs) -> DataFrame:
    """The flat form of what reflection prompts list."""
    return prompts.prompt_blocks(
        i.evidence, ARRIVAL, prompts.reflection_block(), keys=("claim_id", "attempt_no")
    )


@query
def reflection_prompt_parts(i: Inputs) -> DataFrame:
    return prompts.reflection_parts(i.claims, i.evidence, ARRIVAL, PART)


@query
def verdict_prompt_parts(i: Inputs) -> DataFrame:
    stopped = _stopped_once(i)
    return prompts.verdict_parts(
        stopped, verdicts.final_evidence(i.evidence, stopped), ARRIVAL, PART, measured=i.evidence,
    )


@query
def explanation_prompt_parts(i: Inputs) -> DataFrame:
    return _explained(
        i, partial(prompts.explanation_parts_in_row, size=PART), partial(prompts.explanation_parts, size=PART)
    )
