"""Sentence-wise translation through a table of known translations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.language import MIXED, TELUGU, has_telugu
from ..functions.sentences import protect_urls, restore_urls, split_sentences, urls_in
from ..functions.text import as_text, is_blank, strip
from ..sources.replies import Scorer, score_prompts


def needs_translation(language: str = "detected_language") -> Column:
    return F.col(language).isin(TELUGU, MIXED)


def sentences_of(frame: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per sentence: keys, ``sentence_no``, ``sentence``, ``is_telugu``."""
    return frame.select(*keys, F.posexplode(split_sentences(F.col(text)))).select(
        *keys,
        F.col("pos").alias("sentence_no"),
        F.col("col").alias("sentence"),
        has_telugu(F.col("col")).alias("is_telugu"),
    )


def untranslated(frame: DataFrame, text: str, memory: DataFrame) -> DataFrame:
    """Distinct Telugu sentences (addresses masked) that the memory does not know."""
    wanted = (
        frame.select(F.explode(split_sentences(F.col(text))).alias("sentence"))
        .filter(has_telugu(F.col("sentence")))
        .select(protect_urls(F.col("sentence")).alias("source_sentence"))
        .distinct()
    )
    return wanted.join(memory, "source_sentence", "left_anti")


def extend_memory(
    frame: DataFrame, text: str, memory: DataFrame, make_translator: Callable[[], Scorer]
) -> DataFrame:
    """The memory plus model translations of what it lacks; each sentence goes in once."""
    missing = untranslated(frame, text, memory)
    fresh = score_prompts(missing, make_translator, "source_sentence")
    return memory.unionByName(fresh.select("source_sentence", F.col("raw").alias("translated")))


def translation_counts(sentences: Column) -> dict[str, Column]:
    """Columns ``sentences_translated``, ``sentences_skipped`` and ``was_translated``."""
    telugu = F.size(F.filter(sentences, has_telugu))
    return {
        "sentences_translated": telugu,
        "sentences_skipped": F.size(sentences) - telugu,
        "was_translated": telugu > 0,
    }


def sentence_answers(
    frame: DataFrame, keys: list[str], text: str, memory: DataFrame
) -> DataFrame:
    """Per key, a map from sentence number to its translation (``answers``).

    Only Telugu sentences that the memory knows are in it; keys with none have no
    row.  A sentence that many rows share skews the join on its text; adaptive
    execution splits that side, since the memory holds it once.
    """
    asked = (
        frame.select(*keys, F.posexplode(split_sentences(as_text(F.col(text)))))
        .filter(has_telugu(F.col("col")))
        .select(
            *keys,
            "pos",
            protect_urls(F.col("col")).alias("source_sentence"),
            urls_in(F.col("col")).alias("urls"),
        )
    )
    known = memory.groupBy("source_sentence").agg(F.min("translated").alias("translated"))
    answer = strip(restore_urls(F.col("translated"), F.col("urls")))
    return (
        asked.join(known, "source_sentence")
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", answer))).alias("answers"))
    )


def spoken(sentences: Column, answers: Column) -> Column:
    """The sentences put together again, each as its answer where there is one."""
    told = F.transform(sentences, lambda sentence, at: F.coalesce(answers[at], sentence))
    return strip(F.array_join(told, " "))


def translated_text(text: str, answers: str = "answers") -> Column:
    """The translated form of a text with its answers; text without Telugu is only trimmed."""
    value = as_text(F.col(text))
    return F.when(has_telugu(value), spoken(split_sentences(value), F.col(answers))).otherwise(
        strip(value)
    )


def translate(frame: DataFrame, keys: list[str], text: str, memory: DataFrame) -> DataFrame:
    """Add ``translated_text`` and the sentence counts.

    ``keys`` identify a row.  Only rows with Telugu are shuffled: their Telugu
    sentences meet the memory, the answers come back as one map per row, and the
    row puts its sentences together in place.  A sentence the memory lacks stands
    as it is, and still counts as translated.
    """
    value = as_text(F.col(text))
    telugu = frame.filter(has_telugu(value))
    answers = sentence_answers(telugu, keys, text, memory)
    sentences = F.when(is_blank(value), F.array().cast("array<string>")).otherwise(
        split_sentences(value)
    )
    asked = telugu.join(answers, keys, "left")
    plain = frame.filter(~has_telugu(value)).withColumn(
        "answers", F.lit(None).cast(answers.schema["answers"].dataType)
    )

    def finish(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumns({"translated_text": translated_text(text), "_sentences": sentences})
            .withColumns(translation_counts(F.col("_sentences")))
            .drop("_sentences", "answers")
        )

    return finish(asked).unionByName(finish(plain))
