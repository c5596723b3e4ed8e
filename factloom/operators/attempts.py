"""Up to three evidence attempts per claim.

Everything is keyed by claim and at most three rows deep, so evidence is reduced
to one row per claim in a single aggregate.  Claims, metrics and replies then meet
in joins on the claim alone and stay partitioned by it to the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .reflection import METRICS, RESULT, metric_columns, reflect

# --- fixed values -----------------------------------------------------------
MAX_ATTEMPTS = 3
PASS_CONFIDENCE = 0.70
# ----------------------------------------------------------------------------

#: Columns with the recorded reply to each attempt.
REPLIES = [f"_reply_{n}" for n in range(1, MAX_ATTEMPTS + 1)]


def attempt_metrics(evidence: DataFrame, **gathered: Column) -> DataFrame:
    """One row per claim with a struct of metrics per attempt, null where it has no evidence.

    ``gathered`` are further aggregates of the same rows, by name.
    """
    structs = []
    for attempt in range(1, MAX_ATTEMPTS + 1):
        here = F.col("attempt_no") == attempt
        metrics = F.struct(*metric_columns(here))
        structs.append(F.when(F.count_if(here) > 0, metrics).alias(f"attempt_{attempt}"))
    return (
        evidence.filter(F.col("attempt_no").between(1, MAX_ATTEMPTS))
        .groupBy("claim_id")
        .agg(*structs, *[column.alias(name) for name, column in gathered.items()])
    )


def _metrics_by_attempt() -> list[Column]:
    return [F.col(f"attempt_{n}") for n in range(1, MAX_ATTEMPTS + 1)]


def attempt_grid(by_attempt: list[Column], raws: list[str] | None = None) -> list[Column]:
    """One struct per attempt: its number, where its evidence is from, the metrics, and its reply if named."""

    def grid_row(attempt: int) -> Column:
        sources = range(attempt, 0, -1)
        origin = F.coalesce(
            *[F.when(by_attempt[n - 1].isNotNull(), F.lit(n)) for n in sources]
        )
        metrics = F.coalesce(*[by_attempt[n - 1] for n in sources])
        return F.struct(
            F.lit(attempt).alias("attempt_no"),
            origin.alias("evidence_attempt"),
            *[metrics[name].alias(name) for name in METRICS],
            *([F.col(raws[attempt - 1]).alias("raw")] if raws else []),
        )

    return [grid_row(n) for n in range(1, MAX_ATTEMPTS + 1)]


def carried_attempts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """The attempt grid: claims × attempts with the metrics each attempt works on.

    An attempt without evidence works on that of the one before.  A claim without
    evidence in its first attempt is given up and has no rows.  ``evidence_attempt``
    names the attempt the evidence came from.
    """
    grid = F.array(*attempt_grid(_metrics_by_attempt()))
    joined = claims.join(attempt_metrics(evidence), "claim_id").filter(F.col("attempt_1").isNotNull())
    return joined.select(*claims.columns, F.inline(grid))


def given_up(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims without evidence in their first attempt."""
    first = evidence.filter(F.col("attempt_no") == 1).select("claim_id")
    return claims.join(first, "claim_id", "left_anti")


def with_recorded(claims: DataFrame, replies: DataFrame) -> DataFrame:
    """Claims with the reply to each attempt, ``_reply_1`` and on: its earliest try, null if none.

    Replies are gathered per claim first (three at most), so the join is on the
    claim and needs no other partitioning.
    """
    recorded = (
        replies.filter(
            (F.col("stage") == "reflection") & F.col("attempt_no").between(1, MAX_ATTEMPTS)
        )
        .groupBy("claim_id")
        .agg(
            *[
                F.min_by(
                    F.when(F.col("attempt_no") == n, F.col("raw")),
                    F.when(F.col("attempt_no") == n, F.col("try_no")),
                ).alias(name)
                for n, name in enumerate(REPLIES, 1)
            ]
        )
    )
    return claims.join(recorded, "claim_id", "left")


def reflect_attempts(claims: DataFrame, evidence: DataFrame, replies: DataFrame) -> DataFrame:
    """Every attempt of every claim with its reflection result."""
    rows = carried_attempts(with_recorded(claims, replies), evidence)
    raw = F.get(F.array(*REPLIES), F.col("attempt_no") - 1)
    return reflect(rows.withColumn("raw", raw)).drop("raw", *REPLIES)


def passed() -> Column:
    """Whether a reflected attempt settles its claim."""
    return (F.col("decision") == "YES") & (F.col("confidence") >= PASS_CONFIDENCE)


def stop(attempts: DataFrame, keep: list[str]) -> DataFrame:
    """The attempt each claim stops at: the first that passes, else the last.

    ``keep`` are columns of the claim; the result has one row per claim with them,
    the reflection of the chosen attempt, ``attempt_count``, ``evidence_attempt``
    and ``maximum_attempts_reached``.
    """
    preference = F.when(passed(), F.col("attempt_no")).otherwise(
        2 * MAX_ATTEMPTS - F.col("attempt_no")
    )
    carried = [*keep, "attempt_no", "evidence_attempt", *METRICS, *RESULT]
    row = F.struct(*carried, (~passed()).alias("maximum_attempts_reached"))
    chosen = attempts.groupBy("claim_id").agg(F.min_by(row, preference).alias("chosen"))
    return chosen.select("claim_id", "chosen.*").withColumnRenamed("attempt_no", "attempt_count")


def reflect_until_stop(
    claims: DataFrame, evidence: DataFrame, replies: DataFrame, keep: list[str],
    **gathered: Column,
) -> DataFrame:
    """The rows of :func:`stop` over :func:`reflect_attempts`, reflecting no more than they need.

    An attempt is judged in the row of its claim, and only if those before it failed; of an
    attempt that is judged only decision and confidence are worked out.  The last one needs no
    judging.  The whole reflection is made once, of the attempt that is chosen.  Aggregates
    ``gathered`` from the evidence of a claim may be kept like its own columns.
    """
    grid = attempt_grid(_metrics_by_attempt(), REPLIES)
    rows = (
        with_recorded(claims, replies)
        .join(attempt_metrics(evidence, **gathered), "claim_id")
        .filter(F.col("attempt_1").isNotNull())
        .select(
            "claim_id", *dict.fromkeys([*keep, "claim"]),
            *[at.alias(f"_at_{n}") for n, at in enumerate(grid, 1)],
        )
        .withColumn("_stop", F.lit(None).cast("int"))
    )
    own = rows.columns
    for n in range(1, MAX_ATTEMPTS):
        at = F.col(f"_at_{n}")
        # Weak sources are always overruled and a blank claim is always guarded, so neither passes.
        open_ = F.col("_stop").isNull() & ~at["low_authority_only"] & ~is_blank(F.col("claim"))
        tried = rows.withColumns(
            {**{name: at[name] for name in METRICS}, "raw": F.when(open_, at["raw"])}
        )
        judged = reflect(tried).withColumn(
            "_stop", F.coalesce("_stop", F.when(open_ & passed(), F.lit(n)))
        )
        rows = judged.select(*own)
    chosen = F.coalesce(
        *[F.when(F.col("_stop") == n, F.col(f"_at_{n}")) for n in range(1, MAX_ATTEMPTS)],
        F.col(f"_at_{MAX_ATTEMPTS}"),
    )
    last = rows.select("claim_id", *dict.fromkeys([*keep, "claim"]), chosen.alias("_at"))
    once = reflect(last.select("*", "_at.*").drop("_at"))
    return stop(once, keep)
