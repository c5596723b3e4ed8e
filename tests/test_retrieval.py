"""Retrieval by words and by vectors against plain Python, with hot words, copies and odd rows."""

import math
import random
import re

import numpy as np
import pytest

from factloom.operators import retrieval


def words(text):
    return set(re.findall(r"[^\W_]+", (text or "").lower()))


def alike(claims, passages, least, k):
    out = set()
    for claim, text in claims:
        asked = words(text)
        if claim is None or not asked:
            continue
        found = []
        for passage, other in passages:
            given = words(other)
            if passage is None or not given:
                continue
            shared = len(asked & given)
            if shared / len(asked | given) >= least:
                found.append((-shared / len(asked | given), passage, shared))
        out |= {(claim, rank, passage, shared, -likeness) for rank, (likeness, passage, shared) in enumerate(sorted(found)[:k], 1)}
    return out


def texts():
    chance = random.Random(2)
    vocabulary = ["the", "of"] * 30 + [f"word{n}" for n in range(60)]
    prose = lambda n: " ".join(chance.choice(vocabulary) for _ in range(n))
    passages = [prose(chance.randint(1, 14)) for _ in range(700)]
    passages += ["the of the word1"] * 90 + [None, "", "  ", "... !", "été Été", "The Of", "x " * 50_000]
    claims = [prose(chance.randint(1, 10)) for _ in range(40)] + passages[:20] + ["the of word1", "THE", None, "", "ÉTÉ", "x", "none of these"]
    number = lambda rows: [*enumerate(rows), (None, "the of word1")]
    return number(claims), number(passages)


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("postings", [20, 200_000])
def test_lexical_by_brute_force(spark, monkeypatch, least, postings):
    monkeypatch.setattr(retrieval, "POSTINGS", postings)
    claims, passages = texts()
    found = retrieval.retrieve_lexical(
        spark.createDataFrame(claims, "claim long, text string"),
        spark.createDataFrame(passages, "passage long, text string").repartition(6), ["claim"], ["passage"], least, 3,
    )
    assert found.columns == ["claim", "rank", "passage", "shared", "likeness"]
    rows = [tuple(r) for r in found.collect()]
    wanted = alike(claims, passages, least, 3)
    assert len(rows) == len(wanted)
    assert {(*r[:4], round(r[4], 9)) for r in rows} == {(*r[:4], round(r[4], 9)) for r in wanted}


def test_lexical_reads_few_candidates(spark):
    claims, passages = texts()
    asked = retrieval._sets(spark.createDataFrame(claims, "claim long, text string"), ["claim"], "text")
    frame = spark.createDataFrame(passages, "passage long, text string")
    given = retrieval._sets(frame, ["passage"], "text")
    found = retrieval.lexical_candidates(asked.withColumn("key", asked["id.claim"]), given, retrieval.word_counts(frame), 0.8)
    pairs = found.select("claim_key", "id").distinct()
    assert 0 < pairs.count() < 0.05 * asked.count() * given.count()
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString()


def test_empty_tables(spark):
    claims, passages = texts()
    some = spark.createDataFrame(claims, "claim long, text string")
    none = spark.createDataFrame([], "passage long, text string")
    assert retrieval.retrieve_lexical(some, none, ["claim"], ["passage"]).collect() == []
    assert retrieval.retrieve_lexical(some.limit(0), none, ["claim"], ["passage"]).collect() == []
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>")
    assert retrieval.retrieve_topk(rows, rows.limit(0), "id", "id").collect() == []
    assert retrieval.retrieve_topk(rows.limit(0), rows, "id", "id").collect() == []


def nearest(claims, passages, k, not_itself):
    sound = lambda v: v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)
    out = {}
    for claim, v in dict(claims).items():
        if claim is None or not sound(v):
            continue
        found = []
        for passage, w in {(p, tuple(w)): (p, w) for p, w in passages if p is not None and sound(w)}.values():
            if len(w) == len(v) and not (not_itself and passage == claim):
                a, b = np.array(v, dtype=np.float32).astype(float), np.array(w, dtype=np.float32).astype(float)
                found.append((-round(float(a @ b / math.sqrt((a @ a) * (b @ b))), 9), passage))
        if found:
            out[claim] = sorted(found)[:k]
    return out


def vectors(clusters):
    chance = np.random.default_rng(9)
    centres = chance.standard_normal((clusters, 6))
    rows = [(n, [float(c) for c in centres[n % clusters] + chance.standard_normal(6) * 0.05]) for n in range(1200)]
    rows += [(n, rows[7][1]) for n in range(1200, 1500)]  # copies
    rows += [(1500, None), (1501, [0.0] * 6), (1502, [math.nan] * 6), (1503, [math.inf, *[1.0] * 5]), (1504, [None] * 6)]
    rows += [(1505, []), (None, [1.0] * 6), (1600, [1.0, 2.0]), (1601, [2.0, 1.0]), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("clusters", [1, 40])
@pytest.mark.parametrize("not_itself", [True, False])
def test_topk_by_brute_force(spark, monkeypatch, clusters, not_itself):
    monkeypatch.setattr(retrieval, "CELL", 100)
    monkeypatch.setattr(retrieval, "BLOCK", 10)
    rows = vectors(clusters)
    frame = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    visits = []
    found = retrieval.retrieve_topk(
        frame.filter("id % 50 = 0 OR id = 1501"), frame, "id", "id", not_itself=not_itself, visits=visits
    ).collect()
    got = {}
    for row in sorted(found, key=lambda r: (r["claim_id"], r["rank"])):
        got.setdefault(row["claim_id"], []).append((-round(row["score"], 9), row["passage_id"]))
    assert got == nearest([r for r in rows if r[0] is not None and r[0] % 50 == 0], rows, 5, not_itself)
    if clusters == 40:  # bounds leave most cells of other clusters out
        assert sum(scored for _, scored in visits) < 0.3 * len(got) * 1200
