"""Prompts in parts: joined they are the one-row prompts, sizes hold, hot claims are cut."""

import math
import random
from collections import defaultdict

import pytest

from factloom.operators import prompts
from factloom.operators.prompts import prompt_parts

TEXTS = ["", "plain words", "ఒక వాక్యం", "emoji 🙂🙂🙂", "two\nlines\n", "x" * 37]


def model(head, blocks, tail, separator, size):
    """Parts of one prompt by a loop: pieces of at most ``size``, placed by where they start."""
    texts = [head, *[(separator if n else "") + block for n, block in enumerate(blocks)], tail]
    parts, start = defaultdict(str), 0
    for text in texts:
        for at in range(0, len(text), size):
            piece = text[at : at + size]
            parts[start // size + 1] += piece
            start += len(piece)
    return dict(parts)


def made(spark, many, seed):
    draw = random.Random(seed)
    framed = [(n, f"head {n} " * draw.randint(1, 9), "tail " * draw.randint(1, 9)) for n in range(many)]
    blocks = {n: [draw.choice(TEXTS) * draw.randint(1, 3) for _ in range(draw.randint(0, 12))] for n in range(many)}
    rows = [(n, at, text) for n, texts in blocks.items() for at, text in enumerate(texts, 1)]
    rows += [(many + 1, 1, "of no prompt")]
    return (
        framed, blocks,
        spark.createDataFrame(framed, "claim_id bigint, head string, tail string"),
        spark.createDataFrame(rows, "claim_id bigint, position int, block string"),
    )


@pytest.mark.parametrize("size, row_limit", [(10, 1_000_000), (40, 1_000_000), (40, 5), (10_000, 1_000_000)])
def test_parts_equal_a_loop(spark, size, row_limit):
    framed, blocks, frame, flat = made(spark, 12, size)
    found, last = defaultdict(dict), {}
    for row in prompt_parts(frame, flat, "|", size=size, row_limit=row_limit).collect():
        found[row["claim_id"]][row["part_no"]] = row["part"]
        if row["is_last"]:
            last[row["claim_id"]] = row["part_no"]
    assert set(found) == {n for n, *_ in framed}
    for n, head, tail in framed:
        assert found[n] == model(head, blocks[n], tail, "|", size)
        assert sorted(found[n]) == list(range(1, len(found[n]) + 1)) and last[n] == len(found[n])
        whole = "".join(found[n][at] for at in sorted(found[n]))
        assert whole == head + "|".join(blocks[n]) + tail
        assert all(len(part) < 2 * size for part in found[n].values())
        assert len(found[n]) == 1 or len(whole) > size


def test_empty_tables(spark):
    _, _, frame, flat = made(spark, 2, 1)
    assert prompt_parts(frame.limit(0), flat, "|").count() == 0
    assert prompt_parts(frame, flat.limit(0), "|").count() == 2


def test_a_claim_beyond_one_row_gives_bounded_parts(spark):
    """Sixty thousand blocks of one claim; no bucket of the ordered group holds them all."""
    frame = spark.createDataFrame([(7, "head ", " tail")], "claim_id bigint, head string, tail string")
    flat = spark.range(60_000).selectExpr("7L AS claim_id", "CAST(id + 1 AS INT) AS position", "repeat(chr(97 + id % 26), 100) AS block")
    parts = prompt_parts(frame, flat, "\n", size=50_000, row_limit=10_000)
    rows = sorted(parts.collect(), key=lambda row: row["part_no"])
    total = 60_000 * 101 - 1 + 10
    assert [row["part_no"] for row in rows] == list(range(1, math.ceil(total / 50_000) + 1))
    assert max(len(row["part"]) for row in rows) < 100_000
    whole = "".join(row["part"] for row in rows)
    assert whole == "head " + "\n".join(chr(97 + n % 26) * 100 for n in range(60_000)) + " tail"


def test_stages_equal_their_prompts(spark):
    """The parts of each stage, strung together, are the prompts of the one-row form."""
    from factloom.plans import catalog
    from factloom.plans.inputs import Inputs

    inputs = Inputs(spark, "/root/testdata/sf0.001")
    for stage, keys in (("reflection", ("claim_id", "attempt_no")), ("verdict", ("claim_id",)), ("explanation", ("claim_id",))):
        whole = catalog.QUERIES[f"{stage}_prompts"].build(inputs)
        if stage == "verdict":
            whole = whole.filter("try_no = 1")
        joined = defaultdict(list)
        for row in catalog.QUERIES[f"{stage}_prompt_parts"].build(inputs).collect():
            joined[tuple(row[key] for key in keys)].append((row["part_no"], row["part"]))
        texts = {key: "".join(part for _, part in sorted(parts)) for key, parts in joined.items()}
        assert texts == {tuple(row[key] for key in keys): row["prompt"] for row in whole.collect()}
        assert max(map(len, joined.values())) > 1


def test_a_verdict_without_evidence_says_so(spark):
    from tests.test_verification import table

    stopped = spark.createDataFrame(
        [(1, "A claim.", "Finance", 1, False, 0) + (None,) * 3 + (False,) * 4 + (None,) * 2],
        "claim_id bigint, claim string, domain string, attempt_count int, maximum_attempts_reached boolean, "
        "evidence_count bigint, decision string, confidence double, notes string, is_evidence_sufficient boolean, "
        "claim_supported boolean, claim_contradicted boolean, evidence_items_contradict_each_other boolean, "
        "source_credibility_score double, evidence_quality_score double",
    )
    none = table(spark, [])
    whole = prompts.verdict_prompts(stopped, none, ["arrival"], tries=1).first()["prompt"]
    (row,) = prompts.verdict_parts(stopped, none, ["arrival"]).collect()
    assert row["part"] == whole and prompts.NO_EVIDENCE in whole and row["is_last"]


def evidence_rows(spark, many):
    rows = [(n, 1 + at % 2, at, f"ev-{n}-{at}", "x" * (7 * at % 50)) for n in range(many) for at in range(1 + n * n % 9)]
    frame = spark.createDataFrame(rows, "claim_id bigint, attempt_no int, arrival bigint, evidence_id string, text string")
    empty = ["chunk_id string", "document_id string", "source string", "url string", "title string", "retrieval_method string", "authority_score double", "similarity_score double"]
    return frame.selectExpr("*", *[f"CAST(NULL AS {kind}) AS {name}" for name, kind in map(str.split, empty)])


def test_claims_with_more_evidence_are_cut_the_same(spark, monkeypatch):
    claims = spark.createDataFrame([(n, f"Claim {n}. " * 9, None) for n in range(12)], "claim_id bigint, claim string, domain string")
    parts = lambda: sorted(map(tuple, prompts.reflection_parts(claims, evidence_rows(spark, 9), ["arrival"], 100).collect()))
    in_row = parts()
    monkeypatch.setattr(prompts, "IN_ROW", 3)
    assert parts() == in_row and len(in_row) > 100


@pytest.mark.parametrize("stage", [prompts.reflection_prompts, prompts.reflection_parts])
def test_evidence_is_shuffled_once_and_by_claim(spark, stage):
    """Neither rendered blocks nor templates are shuffled: one exchange for evidence, one for claims."""
    claims = spark.createDataFrame([(1, "A claim.", None)], "claim_id bigint, claim string, domain string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = stage(claims, evidence_rows(spark, 3), ["arrival"])
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning(") == 2
