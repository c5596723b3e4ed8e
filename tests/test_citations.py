"""Citations of claims with much evidence and many items."""

import random
import time

import pytest

from factloom.functions.automaton import places
from factloom.operators import verdicts

EVIDENCE = "claim_id bigint, evidence_id string, chunk_id string, document_id string, source string, text string, arrival bigint"


def test_places_by_plain_search():
    chance = random.Random(4)
    draw = lambda n: "".join(chance.choice("abÉ日 ") for _ in range(n))
    for _ in range(200):
        texts = [draw(chance.randint(0, 12)) for _ in range(8)] + [None]
        marks = [m for m in (draw(chance.randint(1, 4)) for _ in range(5)) if m]
        assert places(texts, marks) == [at for at, text in enumerate(texts) if text and any(m in text for m in marks)]
    assert places(["a"], []) == []


def test_work_grows_with_the_sum():
    def seconds(marks, texts):
        started = time.perf_counter()
        places([f"see chunk {n} of the report" for n in range(texts)], [f"mark-{n}-" for n in range(marks)])
        return time.perf_counter() - started

    assert seconds(80_000, 20_000) < 5  # 1.6 billion tests in pairs


@pytest.mark.parametrize("few", [0, 1000, 10**9])
@pytest.mark.parametrize("block", [3000, 100_000])
def test_hot_claim(spark, monkeypatch, few, block):
    monkeypatch.setattr(verdicts, "FEW_TESTS", few)
    monkeypatch.setattr(verdicts, "MARK_BLOCK", block)
    rows = [(1, f"Ev-{n}x", f"chunk-{n}-", None if n % 2 else "", " Reuters " if n == 9 else "ab", f"t{n}", n) for n in range(20_000)]
    rows += [(2, "one", None, "doc", None, None, 1), (2, "one", None, "doc", None, None, 2)]
    items = [f"about EV-{n * 50}X" if n % 3 == 0 else f"nothing {n}" for n in range(497)] + ["REUTERS", "ab", "evidence_0"]
    cited = spark.createDataFrame([(1, items, 20_000), (2, ["DOC", "nothing", " "], 2), (3, ["x"], 1)], "claim_id bigint, items array<string>, evidence_count bigint")
    evidence = spark.createDataFrame(rows, EVIDENCE).repartition(6)
    found = {}
    for row in verdicts.key_evidence(cited, evidence, ["arrival"]).collect():
        found.setdefault(row.claim_id, []).append((row.item_no, row.item))
    kept = [i for at, i in enumerate(items) if at < 497 and at % 3 == 0 and at * 50 < 20_000] + ["REUTERS"]
    assert [i for _, i in sorted(found[1])] == kept
    assert found[2] == [(1, "DOC")] and 3 not in found
