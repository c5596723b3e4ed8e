"""Explanation prompts: evidence is dealt once and stays in the row of its claim, hot claims take flat steps."""

import json
import random
from types import SimpleNamespace

import pytest

from factloom.operators import verdicts
from factloom.plans import catalog

CLAIMS = "claim_id bigint, claim string, domain string"
EVIDENCE = (
    "claim_id bigint, attempt_no int, arrival bigint, evidence_id string, chunk_id string, document_id string, text string, "
    "domain string, source string, language string, similarity_score double, authority_score double, "
    "retrieval_method string, metadata map<string,string>, url string, title string, retrieved_date timestamp, publication_date timestamp"
)
REPLIES = "stage string, claim_id bigint, attempt_no int, try_no int, raw string"
NAMES = ["explanation_prompts", "explanation_prompt_parts"]


def passage(rng, claim_id, arrival):
    return (
        claim_id, rng.choice([1, 1, 1, 2, 3, 4, None]), arrival, rng.choice([None, "", f"Ev-{claim_id}-{arrival}"]),
        rng.choice([None, f"c{arrival}"]), rng.choice([None, "", f"Doc-{arrival % 5}"]),
        rng.choice(["", "Words. " * rng.randint(1, 120), "వాక్యం 🙂"]), "Finance", rng.choice([None, "ab", " Reuters ", ""]),
        "en", rng.choice([None, 0.5, 0.9]), rng.choice([None, 0.25, 0.75]), "web",
        rng.choice([None, {}, {"origin": "x", "place": "y"}]), None, "T", None, None,
    )


def reply(rng, claim_id):
    cites = [*[f"see EV-{claim_id}-{n}" for n in range(4)], "per doc-3", "REUTERS", "item 1", " ", "evidence_2", "evidence_9", "made up", 7, None]
    items = rng.choice(["evidence_1 says", None, [], {"a": 1}, ["made up"], *[rng.sample(cites, 8)] * 5])
    return rng.choice(["", "sorry", "{", '{"final_verdict": "Fake"', "{}"] + 6 * [json.dumps({"final_verdict": "real", "confidence_score": 70, "key_evidence_used": items})])


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(11)
    claims = [(n, rng.choice(["Rain fell.", "Rain fell.", " ", None]), rng.choice([None, "", "Finance"])) for n in range(90)]
    evidence = [passage(rng, n, at) for n in range(90) for at in range(rng.choice([0, 1, 2, 4, 9]))]
    evidence += [passage(rng, None, at) for at in range(5)] + [passage(rng, 1000, 1)]
    said = [("reflection", n, at, 1, rng.choice(["no", '{"decision": "YES", "confidence": 0.9, "evidence_quality_score": 0.8}'])) for n in range(90) for at in (1, 2, 3)]
    told = [("supervisor", n, 1, at, reply(rng, n)) for n in range(90) for at in (1, 2, 3, 4) if n % 7]
    tables = {"claims": (claims, CLAIMS), "evidence": (evidence, EVIDENCE), "replies": (said, REPLIES), "verdict_replies": (told, REPLIES)}
    return SimpleNamespace(**{name: spark.createDataFrame(*rows).repartition(3) for name, rows in tables.items()})


@pytest.mark.parametrize("name", NAMES)
def test_hot_claims_are_told_the_same(inputs, monkeypatch, name):
    """Limits of no row at all, some rows and all rows of evidence: the flat steps, both, and the row."""
    found = []
    for limit in (0, 3, 2_500):
        monkeypatch.setattr(verdicts, "PASSAGE_ROWS", limit)
        found.append(sorted(map(tuple, catalog.QUERIES[name].build(inputs).collect())))
    assert found[0] == found[1] == found[2]
    assert len({row[0] for row in found[0]}) > 30


@pytest.mark.parametrize("name", NAMES)
def test_evidence_is_dealt_once(spark, inputs, name):
    """One exchange each for claims, their replies, their verdicts and their evidence; nothing is written
    out between, and nothing leaves the JVM."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = catalog.QUERIES[name].build(inputs)
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning(") == 4
    assert "ArrowEvalPython" not in plan


def test_all_citations_hold(inputs):
    """Kept items, the fall-back to all evidence, and its numbered names are all among the rows."""
    prompts = [row["prompt"] for row in catalog.QUERIES["explanation_prompts"].build(inputs).collect()]
    cited = [json.loads(text.split("Verdict as JSON: ")[1].split("\n")[0])["key_evidence_used"] for text in prompts]
    assert any("see EV-" in item for items in cited for item in items)
    assert any(item == "Unknown Source (evidence_1)" for items in cited for item in items)
    assert all(items and "made up" not in items and "item 1" not in items for items in cited)
