"""Cleaning with quality flags, and repeat removal in its relational form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def flags_of(*marks: tuple[Column, str]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(mark, F.lit(name)) for mark, name in marks]))


def clean(frame: DataFrame, source: str, text: str = "cleaned_text", flags: str = "quality_flags",
          lines: bool = True) -> DataFrame:
    """Add the cleaned text and its flags.

    Each step is a column of its own, since its result is read twice: by the next
    step and by the flag that asks whether it changed anything.  ``lines=False`` is
    for text that was normalised before and so holds no line breaks; the line steps
    then shrink to closing the gaps that dropped tokens leave.
    """
    staged = (
        frame.withColumn("_raw", tx.as_text(F.col(source)))
        .withColumn("_plain", tx.drop_control_characters(F.col("_raw")))
        .withColumn("_words", tx.drop_noise_tokens(F.col("_plain")))
    )
    marks = [
        (F.col("_plain") != F.col("_raw"), tx.FLAG_CONTROL),
        (F.col("_words") != F.col("_plain"), tx.FLAG_NOISE),
    ]
    if lines:
        staged = staged.withColumn("_lines", tx.tidy_lines(F.col("_words"))).withColumn(
            "_kept", tx.drop_repeated_lines(F.col("_lines"))
        )
        marks.append((F.col("_kept") != F.col("_lines"), tx.FLAG_REPEATED))
        result = tx.strip(F.col("_kept"))
    else:
        result = tx.tidy_spaces(F.col("_words"))
    return staged.withColumns({text: result, flags: flags_of(*marks)}).drop(
        "_raw", "_plain", "_words", "_lines", "_kept"
    )


def flag_counts(frame: DataFrame, flags: str = "quality_flags") -> DataFrame:
    """Rows per flag."""
    return (
        frame.select(F.explode(flags).alias("flag"))
        .groupBy("flag")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def kept_lines(frame: DataFrame, key: str, text: str) -> DataFrame:
    """Relational repeat removal: one row per line that stays, with its place.

    The same rule as the in-row form.  A group is the lines of one text, which
    came out of one row, so the window never holds more than that row did.  Lines
    are compared by hash-free equality on their lower-cased form.
    """
    lines = frame.select(key, F.posexplode(F.split(tx.as_text(F.col(text)), "\n"))).select(
        key,
        F.col("pos").alias("line_no"),
        tx.strip(F.regexp_replace("col", "[ \t]+", " ")).alias("line"),
    )
    filled = F.when(F.col("line") != "", F.lower("line"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        lines.withColumn("_before", F.last(filled, ignorenulls=True).over(before))
        .filter((F.col("line") == "") | ~F.lower("line").eqNullSafe(F.col("_before")))
        .drop("_before")
    )
