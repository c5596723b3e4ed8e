"""Evidence, reflection, attempts, verdicts and explanations: contract cases."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import domains, explanations, prompts
from factloom.operators.attempts import given_up, reflect_attempts, stop
from factloom.operators.reflection import evidence_metrics, reflect
from factloom.operators.verdicts import first_parseable, key_evidence, parse_verdicts, without_verdict
from factloom.plans.verification_flow import verification_report
from factloom.sources.evidence import coerce_loose, split_valid, with_defaults, with_numbered_ids
from factloom.sources.report import write_report

EVIDENCE = (
    "claim_id bigint, attempt_no int, evidence_id string, chunk_id string, document_id string, text string, "
    "domain string, source string, language string, similarity_score double, authority_score double, "
    "retrieval_method string, metadata map<string,string>, url string, title string, arrival int"
)
REPLIES = "stage string, claim_id bigint, attempt_no int, try_no int, raw string"


def item(claim, attempt, similarity, authority, source="Reserve Bank", number=1, **given):
    row = {
        "evidence_id": f"evidence_{number}", "chunk_id": f"chunk_{number}", "document_id": f"document_{number}",
        "language": "en", "retrieval_method": "faiss_local", "metadata": {}, "url": None, "title": "T", **given,
    }
    return (
        claim, attempt, row["evidence_id"], row["chunk_id"], row["document_id"], "text", "Finance", source,
        row["language"], similarity, authority, row["retrieval_method"], row["metadata"], row["url"], row["title"], number,
    )


def table(spark, rows):
    return spark.createDataFrame(rows, EVIDENCE)


def reply(**fields):
    base = {
        "decision": "YES", "confidence": 0.9, "support_score": 0.9, "source_credibility_score": 0.95,
        "evidence_quality_score": 0.9, "claim_supported": True, "notes": "Multiple sources confirm.",
    }
    return json.dumps({**base, **fields})


def judge(spark, items, raw, claim="The bank cut rates.", domain="Finance"):
    rows = [item(1, 1, s, a, number=n) for n, (s, a) in enumerate(items, 1)]
    metrics = evidence_metrics(table(spark, rows), ["claim_id"])
    asked = spark.createDataFrame([(1, claim, domain, raw)], "claim_id bigint, claim string, domain string, raw string")
    return reflect(asked.join(metrics, "claim_id", "left")).first()


def test_strong_evidence(spark):
    row = judge(spark, [(0.95, 0.99)], reply())
    assert (row.decision, row.is_evidence_sufficient, row.claim_supported) == ("YES", True, True)
    assert row.confidence >= 0.70
    assert row.notes == "the single retrieved source confirm."


def test_low_authority(spark):
    row = judge(spark, [(0.95, 0.10)], reply())
    assert (row.decision, row.confidence, row.source_credibility_score) == ("NO", 0.4, 0.1)
    assert row.notes.startswith("Low source credibility detected (max authority: 0.10). ")


def test_guards(spark):
    none = judge(spark, [], reply())
    assert (none.decision, none.confidence) == ("NO", 0.0)
    assert none.notes == "No evidence was provided. Evidence retrieval is required."
    assert judge(spark, [(0.9, 0.9)], reply(), claim="  ").notes == "No claim was provided."


def test_contradictions(spark):
    pair = [(0.94, 0.99), (0.88, 0.85)]
    row = judge(spark, pair, reply(evidence_items_contradict_each_other=True))
    assert row.evidence_items_contradict_each_other and row.contradictions_found
    assert (row.decision, row.confidence) == ("NO", 0.5)
    assert row.notes.endswith(" Unresolved contradictions found between retrieved evidence items.")
    single = judge(
        spark, pair[:1],
        reply(claim_supported=False, claim_contradicted=True, evidence_items_contradict_each_other=True, contradictions_found=True),
    )
    assert (single.claim_supported, single.claim_contradicted) == (False, True)
    assert not single.evidence_items_contradict_each_other and not single.contradictions_found


def test_quality_threshold_and_defaults(spark):
    row = judge(spark, [(0.5, 0.5)], reply(evidence_quality_score="n/a", source_credibility_score=None))
    assert (row.decision, row.confidence, row.evidence_quality_score, row.source_credibility_score) == ("NO", 0.45, 0.5, 0.5)
    assert row.notes.endswith(" Evidence quality score (0.50) or source credibility (0.50) falls below threshold.")
    loose = judge(spark, [(None, None), (0.9, 0.8)], reply(confidence="0.8", claim_supported="false", support_score=7))
    assert (loose.confidence, loose.claim_supported, loose.support_score) == (0.8, True, 1.0)
    assert (loose.avg_similarity, loose.avg_authority, loose.min_authority) == (0.7, 0.55, 0.3)


@pytest.mark.parametrize(
    "raw, notes",
    [
        ("nothing", "Failed to parse valid JSON from LLM."),
        ("{}", "Failed to parse valid JSON from LLM."),
        (None, "Failed to parse valid JSON from LLM."),
        ('{"decision" "YES"}', "LLM execution error: the reply is not valid JSON"),
    ],
)
def test_unusable_replies(spark, raw, notes):
    row = judge(spark, [(0.9, 0.9)], raw)
    assert (row.decision, row.confidence, row.evidence_quality_score, row.notes) == ("NO", 0.0, 0.0, notes)


CLAIMS = [(1, "one", "Finance"), (2, "two", "Finance"), (3, "three", "Finance"), (4, "four", "Finance")]


@pytest.fixture(scope="module")
def run(spark):
    evidence = [
        item(1, 1, 0.95, 0.99),
        item(2, 1, 0.8, 0.1), item(2, 3, 0.9, 0.95, number=3), item(2, 3, 0.9, 0.9, source="Gov", number=4),
        item(3, 1, 0.8, 0.2),
        item(4, 2, 0.9, 0.9),
    ]
    replies = [("reflection", c, a, 1, reply()) for c in (1, 2, 3, 4) for a in (1, 2, 3)]
    verdict = {"final_verdict": "real", "confidence_score": 0.9, "trust_score": 80, "reasoning_summary": "ok"}
    replies += [
        ("supervisor", 1, 1, 1, "sorry"),
        ("supervisor", 1, 1, 2, "```json\n" + json.dumps({**verdict, "key_evidence_used": ["Reserve Bank (evidence_1)", "made up"]}) + "\n```"),
        ("supervisor", 2, 1, 1, json.dumps({**verdict, "final_verdict": "dunno", "key_evidence_used": ["Item 1"]})),
        ("supervisor", 3, 1, 1, "sorry"), ("supervisor", 3, 1, 2, "{"), ("supervisor", 3, 1, 3, "[]"),
        ("explanation", 1, 1, 1, json.dumps({"final_verdict": "Fake", "explanation": "Various sources say so", "confidence": 0})),
        ("explanation", 2, 1, 1, 'x {"evidence_summary": "one", "confidence": 95, "reasoning": "r"} y'),
    ]
    return (
        spark.createDataFrame(CLAIMS, "claim_id bigint, claim string, domain string"),
        table(spark, evidence),
        spark.createDataFrame(replies, REPLIES),
    )


def test_attempts(run):
    claims, evidence, replies = run
    stopped = stop(reflect_attempts(claims, evidence, replies), ["claim"])
    rows = {r.claim_id: r for r in stopped.collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[1].attempt_count, rows[1].maximum_attempts_reached, rows[1].decision) == (1, False, "YES")
    assert (rows[2].attempt_count, rows[2].evidence_attempt, rows[2].maximum_attempts_reached) == (3, 3, False)
    assert (rows[3].attempt_count, rows[3].evidence_attempt, rows[3].maximum_attempts_reached) == (3, 1, True)
    assert [r.claim_id for r in given_up(claims, evidence).collect()] == [4]


def test_report(spark, run, tmp_path):
    report = verification_report(*run, ["arrival"])
    rows = {r.claim_id: r for r in report.collect()}
    assert set(rows) == {1, 2}
    first, second = rows[1], rows[2]
    assert (first.final_verdict, first.confidence_score, first.trust_score) == ("Real", 90, 80)
    assert first.key_evidence_used == ["Reserve Bank (evidence_1)"]
    assert (first.explanation_explanation, first.explanation_confidence) == ("the provided source say so", 0.9)
    assert (first.explanation_reasoning, first.explanation_evidence_summary) == ("N/A", ["Summary provided."])
    assert second.final_verdict == "Unverified"
    assert second.key_evidence_used == ["Reserve Bank (evidence_3)", "Gov (evidence_4)"]
    assert (second.explanation_confidence, second.explanation_evidence_summary) == (0.95, ["one"])
    write_report(report, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report")).count() == 2
    chosen = first_parseable(run[2])
    assert [r.claim_id for r in without_verdict(run[0], chosen).orderBy("claim_id").collect()] == [3, 4]


@pytest.mark.parametrize(
    "value, score",
    [(1.0, 100), (1, 1), ("0.9", 1), (0.555, 56), (72.5, 72), (250, 100), (-3, 0), ("x", 50), (None, 50), (True, 1), ([1], 50)],
)
def test_score_reading(spark, value, score):
    frame = spark.createDataFrame([(1, json.dumps({"confidence_score": value}), 1)], "claim_id int, reply string, evidence_count bigint")
    assert parse_verdicts(frame).first().confidence_score == score


def cited(items, evidence):
    """The citation rule for one claim, over lists."""
    marks = {m.lower() for e in evidence for m in (e[2], e[3], e[4]) if m} | {f"evidence_{n}" for n in range(1, len(evidence) + 1)}
    sources = {e[7].strip().lower() for e in evidence if e[7] and len(e[7].strip()) > 2}
    fixed = {"item 1", "item 2", "source 1", "source 2", "evidence item 1", "evidence item 2"}
    kept = [
        i.strip() for i in items
        if i.strip() and i.strip().lower() not in fixed and any(m in i.lower() for m in marks | sources)
    ]
    return kept or [f"{e[7] or 'Unknown Source'} ({e[2] or e[3] or 'evidence_%d' % n})" for n, e in enumerate(evidence, 1)]


def test_citations_match_rule_for_ordinary_and_hot_claims(spark):
    rows = {
        1: [item(1, 1, 0.5, 0.5, "Ab", n, evidence_id=None if n % 5 else f"e{n}", chunk_id=None if n % 7 else f"c{n}") for n in range(1, 60)],
        2: [item(2, 1, 0.5, 0.5, " Reuters ", 1, evidence_id="x")],
        3: [item(3, 1, 0.5, 0.5, None, n) for n in range(1, 4)],
        4: [],
    }
    items = {
        1: ["item 1", " ", "nothing here"],
        2: ["REUTERS says", "evidence_2", "evidence_10", "doc"],
        3: ["evidence_4", "see Document_3", "Evidence_12"],
        4: ["evidence_1"],
    }
    verdicts = spark.createDataFrame(
        [(k, v, len(rows[k])) for k, v in items.items()], "claim_id bigint, items array<string>, evidence_count bigint"
    )
    evidence = table(spark, [row for listed in rows.values() for row in listed])
    for limit in (1_000_000, 10):
        found = {}
        for row in key_evidence(verdicts, evidence, ["arrival"], limit).collect():
            found.setdefault(row.claim_id, []).append((row.item_no, row.item))
        assert {k: [i for _, i in sorted(v)] for k, v in found.items()} == {k: cited(items[k], rows[k]) for k in (1, 2, 3)}


@pytest.mark.parametrize(
    "raw, score, wanted",
    [
        ('{"confidence": 0.4}', 90, 0.4), ('{"confidence": 40}', 90, 0.4), ('{"confidence": 400}', 90, 0.9),
        ('{"confidence": "0"}', 90, 0.9), ('{"confidence": 0}', 0, 0.0), ("{}", 0, 0.85), ("{}", 1, 1.0), ("{}", None, 0.85),
    ],
)
def test_explanation_confidence(spark, raw, score, wanted):
    frame = spark.createDataFrame([(raw, "Real", score, 2)], "raw string, final_verdict string, confidence_score int, evidence_count bigint")
    assert explanations.validate(explanations.parse_replies(frame)).first().confidence == wanted


@pytest.mark.parametrize(
    "raw, error",
    [("none", explanations.NOT_JSON), ("[1]", explanations.NOT_OBJECT), ('a {"x": 1} b', None), ("```\n{}\n```", None)],
)
def test_explanation_parsing(spark, raw, error):
    row = explanations.parse_replies(spark.createDataFrame([(raw,)], "raw string")).first()
    assert row.reply_error == error


def test_evidence_contract(spark):
    rows = [item(1, 1, 0.5, 0.5, number=2), item(1, 1, None, 0.5, None, 1, evidence_id=None, chunk_id=None, title="", retrieval_method="web")]
    frame = table(spark, rows).withColumn("retrieved_date", F.lit(None).cast("timestamp"))
    good, broken = split_valid(frame)
    assert good.count() == 1
    assert broken.first().violations == ["missing chunk_id", "missing source", "missing similarity_score", "unknown retrieval_method"]
    for limit in (100, 1):
        named = {r.arrival: r for r in with_defaults(with_numbered_ids(frame, ["arrival"], row_limit=limit)).collect()}
        assert (named[1].evidence_id, named[1].chunk_id, named[1].title) == ("evidence_1", "chunk_1", "Test Evidence 1")
        assert (named[2].evidence_id, named[2].title) == ("evidence_2", "T")
        assert named[2].retrieved_date is not None
    loose = spark.createDataFrame([('{"text": "t", "similarity_score": "0.5"}',), ("[1]",), ("plain",)], "raw string")
    found = [(r.text, r.similarity_score) for r in coerce_loose(loose, "raw").collect()]
    assert found == [("t", 0.5), ("[1]", None), ("plain", None)]


# The labelled claims of the evaluation set (fixed values).
LABELLED = [
    ("WHO approves a new malaria vaccine.", "Medical"),
    ("A new COVID-19 variant has been detected in India.", "Medical"),
    ("Doctors recommend annual flu vaccination.", "Medical"),
    ("The Election Commission announced polling dates.", "Politics"),
    ("Parliament passed the Digital India Bill.", "Politics"),
    ("The Prime Minister addressed the nation on economic reforms.", "Politics"),
    ("RBI increased the repo rate by 25 basis points.", "Finance"),
    ("SEBI introduced new stock market regulations.", "Finance"),
    ("Bitcoin crossed ₹80 lakh in trading today.", "Finance"),
    ("Google launched its latest Gemini AI model.", "Technology"),
    ("Microsoft released a major Windows security update.", "Technology"),
    ("OpenAI introduced a new multimodal language model.", "Technology"),
    ("Heavy rain stopped the match.", "Unknown"),
]


def test_labelled_claims_are_fitted(spark):
    frame = spark.createDataFrame(LABELLED, "claim string, expected_domain string")
    rows = {r.expected_domain: r.accuracy for r in domains.confusion(domains.classify(frame, "claim")).collect()}
    assert rows == {name: 1.0 for name in domains.DOMAINS}


def test_prompts(spark, run):
    claims, evidence, replies = run
    asked = {(r.claim_id, r.attempt_no): r.prompt for r in prompts.reflection_prompts(claims, evidence, ["arrival"]).collect()}
    cut = {(r.claim_id, r.attempt_no): r.prompt for r in prompts.reflection_prompts(claims, evidence, ["arrival"], 1).collect()}
    assert asked == cut
    assert "Passages found: 2" in asked[2, 3]
    assert asked[2, 3].index("id=evidence_3") < asked[2, 3].index("id=evidence_4")
    stopped = stop(reflect_attempts(claims, evidence, replies), ["claim", "domain"])
    tries = {(r.claim_id, r.try_no): r.prompt for r in prompts.verdict_prompts(stopped, evidence, ["arrival"], tries=2).collect()}
    assert tries[1, 2] == tries[1, 1] + prompts.RETRY_REMINDER
    assert prompts.NO_REFLECTION not in tries[1, 1]
