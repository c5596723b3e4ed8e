"""The attempt rule on a stream: attempts of a claim arrive one by one, in any order.

An attempt is an event: its claim, its number, the metrics of its evidence (null if it found
none) and the recorded reply.  State holds the attempts of claims that are not settled, keyed
by claim.  Each event hands on what is known of its claim so far, as rows of the attempt grid
(an attempt without evidence works on that of the one before); :func:`decided` turns the rows
of a micro-batch into one row per claim with the batch rule.  A claim is settled when all
attempts are there, or when the watermark has passed ``wait`` after its last event; then
missing attempts count as empty ones, as in a batch, and its state is removed.

Events later than the watermark are dropped, as everywhere in Structured Streaming; late ones
within it are merged, whatever has been handed on before.  Fields of repeated events of one
attempt complete each other, the newer filled one counts.  Null claim ids take no part.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.attempts import MAX_ATTEMPTS, stop
from ..operators.reflection import METRICS, evidence_metrics, reflect

# The processor travels to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_METRIC_TYPES = ["bigint", "double", "double", "double", "double", "boolean", "boolean"]
_METRIC_DDL = ", ".join(f"{name} {kind}" for name, kind in zip(METRICS, _METRIC_TYPES))
EVENTS = f"claim_id bigint, claim string, domain string, attempt_no int, {_METRIC_DDL}, raw string, at timestamp"
CARRIED = (
    f"claim_id bigint, claim string, domain string, attempt_no int, evidence_attempt int, {_METRIC_DDL}, "
    "raw string, settled boolean"
)
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def attempt_events(claims: DataFrame, evidence: DataFrame, replies: DataFrame) -> DataFrame:
    """Events of finished tables, without their time ``at``: one per claim and attempt.

    Attempts that found nothing and have no reply make no event.
    """
    numbered = F.col("attempt_no").between(1, MAX_ATTEMPTS)
    metrics = evidence_metrics(evidence.filter(numbered), ["claim_id", "attempt_no"])
    said = (
        replies.filter((F.col("stage") == "reflection") & numbered)
        .groupBy("claim_id", "attempt_no").agg(F.min_by("raw", "try_no").alias("raw"))
    )
    known = metrics.join(said, ["claim_id", "attempt_no"], "full")
    return claims.select("claim_id", "claim", "domain").join(known, "claim_id").select(
        "claim_id", "claim", "domain", "attempt_no", *METRICS, "raw"
    )


class Carry(StatefulProcessor):
    """Keeps the attempts of one claim and hands on its grid."""

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.attempts = handle.getMapState("attempts", "attempt_no int", "event string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for frame in rows:
            latest = max(latest, int(frame["at"].max().timestamp() * 1000))
            for row in frame.sort_values("at").drop(columns=["at"]).to_dict("records"):
                number = row["attempt_no"]
                if pd.isna(number) or not 1 <= number <= MAX_ATTEMPTS:
                    continue
                number = (int(number),)
                known = json.loads(self.attempts.getValue(number)[0]) if self.attempts.containsKey(number) else {}
                fresh = {name: plain(value) for name, value in row.items() if not pd.isna(value)}
                self.attempts.updateValue(number, (json.dumps(known | fresh),))
        held = self.held()
        if len(held) == MAX_ATTEMPTS:
            self.settle()
            yield grid(key[0], held, True)
            return
        for timer in [*self.handle.listTimers()]:
            latest = max(latest, timer - self.wait_ms)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.wait_ms)
        yield grid(key[0], held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held()
        self.settle()
        yield grid(key[0], held, True)

    def held(self) -> dict[int, dict]:
        return {number[0]: json.loads(event[0]) for number, event in self.attempts.iterator()}

    def settle(self) -> None:
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        self.attempts.clear()

    def close(self) -> None:
        pass


def plain(value):
    """A number of numpy as one of Python."""
    return value.item() if hasattr(value, "item") else value


def grid(claim_id: int, held: dict[int, dict], settled: bool) -> pd.DataFrame:
    """The attempts known from the first on, or all if settled, with the metrics they work on."""
    names = [field.split()[0] for field in CARRIED.split(", ")]
    rows, metrics, origin = [], None, None
    for number in range(1, MAX_ATTEMPTS + 1):
        event = held.get(number)
        if event is None and not settled:
            break
        event = event or {}
        if event.get("evidence_count"):
            metrics, origin = {name: event.get(name) for name in METRICS}, number
        if metrics is None:
            break  # nothing found at first: given up
        said = {name: next((e[name] for e in held.values() if e.get(name) is not None), None) for name in ("claim", "domain")}
        rows.append(
            {"claim_id": claim_id, **said, "attempt_no": number, "evidence_attempt": origin, **metrics,
             "raw": event.get("raw"), "settled": settled}
        )
    return pd.DataFrame(rows, columns=names)


def carried_stream(events: DataFrame, delay: str = "10 minutes", wait_ms: int = 3_600_000) -> DataFrame:
    """The growing attempt grids of streamed :data:`EVENTS`, see the module.

    ``delay`` is how late events may be, ``wait_ms`` how long a claim waits for its next attempt.
    The session keeps state in RocksDB from here on, which this operator needs.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return (
        events.filter(F.col("claim_id").isNotNull() & F.col("at").isNotNull())
        .withWatermark("at", delay)
        .groupBy("claim_id")
        .transformWithStateInPandas(Carry(wait_ms), CARRIED, "Append", "EventTime")
    )


def decided(rows: DataFrame) -> DataFrame:
    """One row per claim of a micro-batch of grids: the batch rule, and whether it can still change.

    For :func:`..flows.per_batch`, whose folders replace each other when a batch is replayed.
    """
    found = stop(reflect(rows).drop("raw"), ["claim", "domain", "settled"])
    return found.withColumn("final", F.col("settled") | ~F.col("maximum_attempts_reached")).drop("settled")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each claim that :func:`decided` has written, batch by batch."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("claim_id").agg(F.max_by(F.struct(*rows.columns[1:]), "batch").alias("row"))
    return newest.select("claim_id", "row.*").drop("batch")


