"""Reflecting attempts only as far as the stop rule needs them."""

import itertools
import json
import random

from pyspark.sql import functions as F

from factloom.functions import modeljson as mj
from factloom.operators.attempts import reflect_attempts, reflect_until_stop, stop
from factloom.operators.reflection import UNPARSED, parse_replies

EVIDENCE = "claim_id bigint, attempt_no int, similarity_score double, authority_score double"
REPLIES = "stage string, claim_id bigint, attempt_no int, try_no int, raw string"
CLAIMS = "claim_id bigint, claim string, domain string"


def reply(rng):
    return rng.choice(
        [
            None, "", "sorry", "{}", "{ }", "{\n\t}", '{} and {"decision": "YES"}', '{"decision": "YES" 1}', "[{}]",
            *[
                "so " + json.dumps(
                    {
                        "decision": rng.choice(["YES", " yes ", "no", True, None]),
                        "confidence": rng.choice([0.695, 0.694, 0.7, "0.9", True, 5, -1, "1e-1", "NaN", None, [1]]),
                        "source_credibility_score": rng.choice([0.2, 0.9, "x", 1]),
                        "evidence_quality_score": rng.choice([0.5, 0.6, 0.8, None]),
                        "evidence_items_contradict_each_other": rng.choice([False, "", 0, "no", {}]),
                        "contradictions_found": rng.choice([False, [1]]),
                        "notes": rng.choice(["Multiple sources agree", "", None, 4]),
                    }
                )
                for _ in range(30)
            ],
        ]
    )


def test_same_rows_as_reflecting_every_attempt(spark):
    rng = random.Random(7)
    claims, evidence, replies = [], [], []
    for claim_id in range(600):
        claims.append((claim_id, rng.choice(["Rain", "Rain", "Rain", "  ", None]), rng.choice(["Finance", None, ""])))
        for attempt in (1, 2, 3, 4):
            for _ in range(rng.choice([0, 1, 1, 3])):
                evidence.append((claim_id, attempt, rng.choice([None, 0.5, 0.9]), rng.choice([None, 0.2, 0.7, 0.9])))
            for try_no in range(1, rng.choice([1, 2, 3])):
                replies.append(("reflection", claim_id, attempt, try_no, reply(rng)))
    run = (
        spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(evidence, EVIDENCE),
        spark.createDataFrame(replies, REPLIES),
    )
    wanted = stop(reflect_attempts(*run), ["claim", "domain"])
    found = reflect_until_stop(*run, ["claim", "domain"])
    assert found.schema.simpleString() == wanted.schema.simpleString()
    rows = {repr(row) for row in wanted.collect()}
    assert {repr(row) for row in found.collect()} == rows
    reached = {(row["attempt_count"], row["maximum_attempts_reached"]) for row in found.collect()}
    assert reached == {(1, False), (2, False), (3, False), (3, True)}
    # Without the claim among the kept columns, and a claim that comes twice is one row.
    twice = (run[0].unionByName(run[0]), *run[1:])
    assert reflect_until_stop(*twice, ["domain"]).count() == len(rows)


def test_attempts_are_no_rows(spark):
    claims = spark.createDataFrame([(1, "Rain", "Finance")], CLAIMS)
    evidence = spark.createDataFrame([(1, 1, 0.9, 0.9)], EVIDENCE)
    found = reflect_until_stop(claims, evidence, spark.createDataFrame([], REPLIES), ["claim"])
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    (row,) = found.collect()
    assert (row["attempt_count"], row["decision"], row["notes"]) == (3, "NO", UNPARSED)


def test_empty_objects_are_unparsed(spark):
    blanks = ["", " ", "\n", "\t\r ", " ", "\x0b", "\x0c", "/**/", ",", '"a": 1', '"": null', "{}"]
    texts = [f"x {{{a}}}{b}" for a, b in itertools.product(blanks, ["", " y", " } z", '{"a": 1}'])]
    frame = spark.createDataFrame(list(enumerate(texts)), "at int, raw string")
    doc = mj.parse(mj.braces_slice(F.col("raw")))
    empty = F.coalesce(F.try_variant_get(doc, "$", "string") == "{}", F.lit(False))
    rows = parse_replies(frame.withColumn("empty", empty)).select(
        "raw", "empty", (F.col("reply_error") == UNPARSED).alias("told"), F.col("doc").isNull().alias("none")
    ).collect()
    assert any(row["empty"] for row in rows) and not all(row["empty"] for row in rows)
    for row in rows:
        assert row["empty"] == bool(row["told"]), row
        assert row["none"] or not row["empty"], row
