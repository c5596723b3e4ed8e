"""A corpus from raw documents to packed sequences, stage by stage.

Each stage gets what its predecessor kept, whole.  Stages but the last return the columns
of ``documents``.  Models of a stage are learned from the labelled documents among its
input.  Null and empty texts pass through every stage like other texts, repeated rows are
judged one by one (and are copies to the near-duplicate stage), and an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import packing, quality, simhash, toxicity
from factloom.llm.common import removed, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic documents."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five words, likeness 0.8)."""
    return simhash.keep_first(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of all documents into sequences."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("toxicity", civil_documents),
    ("near_duplicates", different_documents),
    ("packing", packed_sequences),
]

#: Learned models, fingerprints and token ids are nothing that SQL expresses.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``; what stands between them is written and read again.

    A stage's folder is removed when the next one is written, and that of the last but one
    when the last stage has pinned the pieces it packs, so none is left behind.
    """
    docs, folder = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, new = stored(stage(spark, docs, sf_dir))
        if folder:
            removed(spark, folder)
        folder = new
    result = STAGES[-1][1](spark, docs, sf_dir)
    removed(spark, folder)
    return result
