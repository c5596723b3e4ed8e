"""Structured Streaming forms.

Text work is stateless, so it runs unchanged on a stream in append mode.  Steps
that gather rows of a key (images, attempts, verdicts) need complete groups; they
run per micro-batch on batches that carry whole groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import strip
from ..operators.segments import with_clean_text, with_language
from ..sources.submissions import with_presence


def text_stream(submissions: DataFrame) -> DataFrame:
    """Language, clean text and flags of the text of streamed submissions.

    Works on batch input as well, with equal results.  Translation is left to a
    later step, since it looks sentences up in a table.
    """
    texts = with_presence(submissions).filter("had_text")
    return with_clean_text(
        with_language(texts.withColumn("original_text", strip(F.col("text"))))
    )


def write_stream(stream: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append a stream to parquet files."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start(path)


def per_batch(
    stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
    **trigger: object,
) -> StreamingQuery:
    """Run a table-level operator on every micro-batch, one output folder per batch.

    The folder carries the batch number and is overwritten, so a batch that is
    replayed after a failure replaces its own output instead of adding to it.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
