"""Attempts that arrive over time, against the batch rule on all of them."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.operators.attempts import reflect_attempts, stop
from factloom.streaming import attempts
from factloom.streaming.flows import per_batch

START = datetime(2024, 1, 1)


def tables(spark):
    evidence, replies = [], []
    for claim in range(1, 9):
        for number in (1, 2, 3):
            # 2 and 3 find nothing later, 4 nothing at first, 5 has a gap in the middle.
            if not (claim in (2, 3) and number > 1 or claim == 4 and number == 1 or claim == 5 and number == 2):
                evidence += [(claim, number, 0.2 * number, 0.3 + 0.1 * claim) for _ in range(number)]
            sure = claim == 1 or claim == 6 and number == 2
            reply = {"decision": "YES" if sure else "NO", "confidence": 0.9 if sure else 0.1 * number, "evidence_quality_score": 0.9, "source_credibility_score": 0.9}
            if not (claim == 3 and number > 1):
                replies.append(("reflection", claim, number, 1, json.dumps(reply)))
    return (
        spark.createDataFrame([(c, f"claim {c}", "Finance") for c in range(1, 9)], "claim_id bigint, claim string, domain string"),
        spark.createDataFrame(evidence, "claim_id bigint, attempt_no int, similarity_score double, authority_score double"),
        spark.createDataFrame(replies, "stage string, claim_id bigint, attempt_no int, try_no int, raw string"),
    )


def shown(rows):
    return sorted(repr({k: v for k, v in r.asDict().items() if k != "final"}) for r in rows)


@pytest.mark.parametrize("order", [[1, 2, 3], [3, 1, 2], [2, 3, 1]])
def test_three_batches_equal_the_batch_run(spark, tmp_path, order):
    run = tables(spark)
    wanted = stop(reflect_attempts(*run), ["claim", "domain"])
    events = attempts.attempt_events(*run)
    source = str(tmp_path / "events")

    def arrive(rows, minute):
        at = F.lit(START + timedelta(minutes=minute)).cast("timestamp")
        rows.withColumn("at", at).select(*[f.split()[0] for f in attempts.EVENTS.split(", ")]).coalesce(1).write.mode("append").parquet(source)
        # Each batch is a new start from the checkpoint.
        stream = spark.readStream.schema(attempts.EVENTS).parquet(source)
        query = per_batch(
            attempts.carried_stream(stream, "10 minutes", 60_000), attempts.decided,
            str(tmp_path / "out"), str(tmp_path / "checkpoint"), availableNow=True,
        )
        query.awaitTermination()
        assert query.exception() is None
        return query.recentProgress

    for minute, number in enumerate(order):
        arrive(events.filter(F.col("attempt_no") == number), minute)
    # Far later events push the watermark on: waiting ends, and all state goes but theirs.
    other = events.filter("claim_id = 7 AND attempt_no = 1").withColumn("claim_id", F.lit(70).cast("bigint"))
    arrive(other, 100)
    progress = arrive(other.withColumn("claim_id", F.lit(71).cast("bigint")), 300)
    found = [r for r in attempts.latest(spark, str(tmp_path / "out")).collect() if r["claim_id"] < 70]
    assert shown(found) == shown(wanted.select(*[c for c in found[0].asDict() if c != "final"]).collect())
    assert all(r["final"] for r in found)
    left = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert left and left[-1] <= 6  # the last claim alone: an attempt and a timer with its index
    # An event behind the watermark changes nothing.
    arrive(events.filter("claim_id = 2 AND attempt_no = 1"), 1)
    again = [r for r in attempts.latest(spark, str(tmp_path / "out")).collect() if r["claim_id"] < 70]
    assert shown(again) == shown(found)


def test_grid_of_what_is_known():
    event = {"evidence_count": 2, "avg_similarity": 0.5, "raw": "r"}
    assert list(attempts.grid(1, {1: event}, False)["attempt_no"]) == [1]
    assert list(attempts.grid(1, {1: event, 3: event}, False)["attempt_no"]) == [1]
    assert list(attempts.grid(1, {1: event, 3: event}, True)["evidence_attempt"]) == [1, 1, 3]
    assert not len(attempts.grid(1, {2: event}, True)) and not len(attempts.grid(1, {2: event}, False))
