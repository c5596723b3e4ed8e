"""Every claim is in the report or among the rejects, and ids and replies are stable."""

import pytest
from pyspark.sql import functions as F

from factloom.operators.verdicts import first_parseable, parse_verdicts
from factloom.plans.inputs import Inputs
from factloom.plans.verification_flow import (
    explanation_docs, verification_rejects, verification_report, verification_tables,
)
from factloom.sources.evidence import coerce_loose, with_defaults

FOLDER = "/root/testdata/sf0.001"


def test_report_and_rejects_are_all_claims(spark):
    i = Inputs(spark, FOLDER)
    replies = i.replies.filter("NOT (stage = 'supervisor' AND claim_id % 10 = 1)")
    told = verification_report(i.claims, i.evidence, replies, ["arrival"]).select("claim_id")
    rejected = verification_rejects(i.claims, i.evidence, replies)
    assert {r.stage for r in rejected.collect()} == {"evidence", "verdict", "explanation"}
    ours = sorted(r.claim_id for r in told.unionByName(rejected.select("claim_id")).collect())
    assert ours == sorted(r.claim_id for r in i.claims.select("claim_id").collect())


def test_derived_ids_are_the_same_in_every_plan(spark):
    i = Inputs(spark, FOLDER)
    bare = i.evidence.drop("evidence_id").selectExpr("*", "cast(null as string) AS evidence_id")
    first, second = (
        {(r.claim_id, r.arrival): r.evidence_id for r in with_defaults(bare.repartition(n)).collect()} for n in (1, 5)
    )
    assert first == second and len(set(first.values())) == len(first)


@pytest.mark.parametrize("setting", ["false", "true"])
def test_last_value_of_a_repeated_key_counts(spark, setting):
    other = spark.newSession()
    other.conf.set("spark.sql.variant.allowDuplicateKeys", setting)
    raw = '{"final_verdict": "Fake", "trust_score": 7, "final_verdict": "Real"}'
    replies = other.createDataFrame(
        [("supervisor", 1, 1, 1, raw)], "stage string, claim_id long, attempt_no int, try_no int, raw string"
    )
    chosen = first_parseable(replies).withColumn("evidence_count", F.lit(1))
    assert parse_verdicts(chosen).first().final_verdict == "Real"
    again = other.createDataFrame([('{"text": "x", "text": "y"}',)], "raw string")
    assert coerce_loose(again, "raw").first().text == "y"


def test_loose_evidence_keeps_all_fields(spark):
    raw = '{"text": "t", "language": "te", "metadata": {"a": [1]}, "page": 7, "nested": {"k": "v"}, "gone": null}'
    row = coerce_loose(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    assert (row.text, row.language, row.metadata) == ("t", "te", '{"a":[1]}')
    assert row.other == {"page": "7", "nested": '{"k":"v"}', "gone": None}


def test_a_reply_is_parsed_before_it_is_tested(spark):
    """Each test of a parsed explanation that moves below it would parse the reply again."""
    i = Inputs(spark, "/root/testdata/sf0.001")
    for frame in verification_tables(i.claims, i.evidence, i.replies, ["arrival"]):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.split("\n") if "Filter" in line and "parseJson" in line]


def test_the_earliest_explanation_counts(spark):
    said = [
        ("explanation", 1, 1, 2, '{"a": 1}'), ("explanation", 1, 1, 1, "no"), ("explanation", 2, 1, 1, 'x {"a": 1} y'),
        ("explanation", 2, 1, 2, "no"), ("explanation", 3, 1, 1, None), ("explanation", 4, 1, 1, "[1]"), ("supervisor", 5, 1, 1, "{}"),
    ]
    replies = spark.createDataFrame(said, "stage string, claim_id bigint, attempt_no int, try_no int, raw string")
    rows = {r.claim_id: (r.none, r.usable) for r in explanation_docs(replies).selectExpr("claim_id", "doc IS NULL AS none", "usable").collect()}
    assert rows == {1: (True, False), 2: (False, True), 3: (True, False), 4: (True, False)}
