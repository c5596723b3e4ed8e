"""Model replies: recorded ones by join, or fresh ones from a scorer of the user's.

A reply store keeps what a scorer has said, addressed by what it was asked: the key is a hash
of stage, template version and prompt.  Only prompts without a reply are scored, each once
however often it is asked.  Each run commits a folder of its own; one that fails midway leaves
a folder that does not count and that the next run replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import names, written

#: Columns of a reply store; a row with an ``error`` has no reply and is asked again.
STORE = "key string, stage string, version string, raw string, error string"
#: Takes a batch of prompts, returns one reply text per prompt.
Scorer = Callable[[pd.Series], pd.Series]


def attach_replies(
    requests: DataFrame, replies: DataFrame, stage: str, keys: list[str]
) -> DataFrame:
    """Left-join the recorded reply of one stage as ``raw`` (null where none was recorded).

    Should a key hold several recordings, the earliest try wins.
    """
    recorded = (
        replies.filter(F.col("stage") == stage)
        .groupBy(*keys)
        .agg(F.min_by("raw", "try_no").alias("raw"))
    )
    return requests.join(recorded, keys, "left")


def score_prompts(
    prompts: DataFrame, make_scorer: Callable[[], Scorer], prompt: str = "prompt"
) -> DataFrame:
    """Add ``raw`` by running a model over the prompts, batch by batch.

    ``make_scorer`` runs once per task, so a model is loaded once and then fed
    whole Arrow batches.  Rows that need no model should be filtered out before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            yield batch.assign(raw=scorer(batch[prompt]).to_numpy())

    fields = ", ".join(
        f"`{field.name}` {field.dataType.simpleString()}" for field in prompts.schema.fields
    )
    return prompts.mapInPandas(run, f"{fields}, raw STRING")


def prompt_key(stage: str, version: str, prompt: str = "prompt") -> Column:
    """What a reply is stored under."""
    return F.sha2(F.to_json(F.struct(F.lit(stage).alias("s"), F.lit(version).alias("v"), F.col(prompt).alias("p"))), 256)


def _commits(spark: SparkSession, store: str) -> list[str]:
    return [f"{store}/{name}" for name in names(spark, store) if written(spark, f"{store}/{name}")]


def stored_replies(spark: SparkSession, store: str) -> DataFrame:
    """The replies of a store, one per key: (key, stage, version, raw)."""
    commits = _commits(spark, store)
    rows = spark.read.schema(STORE).parquet(*commits) if commits else spark.createDataFrame([], STORE)
    said = rows.filter(F.col("error").isNull())
    return said.groupBy("key").agg(*[F.min(name).alias(name) for name in ("stage", "version", "raw")])


def pending_prompts(prompts: DataFrame, store: str, stage: str, version: str, prompt: str = "prompt") -> DataFrame:
    """(key, prompt) of the distinct prompts that the store has no reply to; null prompts ask nothing."""
    asked = prompts.filter(F.col(prompt).isNotNull()).select(
        prompt_key(stage, version, prompt).alias("key"), F.col(prompt).alias("prompt")
    )
    known = stored_replies(prompts.sparkSession, store).select("key")
    return asked.dropDuplicates(["key"]).join(known, "key", "left_anti")


def score_pending(
    prompts: DataFrame, make_scorer: Callable[[], Scorer], store: str, stage: str, version: str,
    prompt: str = "prompt", batch_rows: int = 256,
) -> DataFrame:
    """Score what is pending, commit it, and add ``raw`` from the store to all prompts.

    A batch of ``batch_rows`` prompts whose scorer raises, or gives no text for a prompt,
    is recorded as an error and stays pending; its prompts have a null ``raw``, and all other
    replies are kept.  Scoring runs once, in the job that writes the commit.
    """
    spark = prompts.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            for start in range(0, len(frame), batch_rows):
                some = frame.iloc[start : start + batch_rows]
                raw, error = pd.Series([None] * len(some), dtype=object), None
                try:
                    raw = pd.Series(scorer(some["prompt"]).to_numpy(), dtype=object)
                except Exception as problem:  # noqa: BLE001  whatever the scorer raises
                    error = f"{type(problem).__name__}: {problem}"
                yield pd.DataFrame(
                    {
                        "key": some["key"].to_numpy(), "stage": stage, "version": version, "raw": raw,
                        "error": [None if isinstance(r, str) else error or "no reply" for r in raw],
                    }
                )

    pending = pending_prompts(prompts, store, stage, version, prompt)
    if not pending.isEmpty():
        # The number after the last that counts: what a failed run has left there is replaced.
        commit = f"{store}/commit-{len(_commits(spark, store)):09d}"
        pending.mapInPandas(run, STORE).write.mode("overwrite").parquet(commit)
    said = stored_replies(spark, store).select(F.col("key").alias("_key"), "raw")
    return prompts.withColumn("_key", prompt_key(stage, version, prompt)).join(said, "_key", "left").drop("_key")
