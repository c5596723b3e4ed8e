"""Hard negatives by brute force, and what the buckets spare."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from factloom.llm import negatives


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string, part int, length double, score double, ids int")


def by_hand(rows, every=100):
    good = {}
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = tuple(math.floor(256 * float(np.float32(c))) for c in v)
        if sum(c * c for c in x) > 2**58:
            continue
        good[(vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, x)] = None
    out = set()
    for anchor, label, x in good:
        if anchor % every:
            continue
        score = {g: sum(a * b for a, b in zip(x, g[2])) for g in good if len(g[2]) == len(x)}
        order = sorted(score, key=lambda g: (-score[g], g[0]))
        for positive in [g for g in order if g[1] == label and g[0] != anchor][:5]:
            p = score[positive]
            fits = [g for g in order if g[1] != label and 80 * p <= 100 * score[g] <= 100 * p][:5]
            out |= {(anchor, positive[0], rank, g[0], p, score[g]) for rank, g in enumerate(fits, 1)}
    return out


def got(frame):
    assert frame.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def odd_rows():
    chance = random.Random(5)
    clash = ("k", 1, 2.0, 0.5, 3)
    draw = lambda n, width=8: [chance.gauss(0, n) for _ in range(width)]
    rows = [(at, draw(chance.choice([0.1, 0.5, 2.0])), at % 4, *clash) for at in range(600)]
    hot = draw(0.4)
    rows += [(at, hot, at % 3, *clash) for at in range(600, 900)]  # copies under many ids
    rows += [(at, [c + chance.gauss(0, 0.01) for c in hot], at % 2, *clash) for at in range(900, 1000)]
    rows += [(1000, [0.0] * 8, 1, *clash), (1001, [0.0] * 8, 2, *clash), (1100, [], 1, *clash), (1200, draw(1, 3), 1, *clash)]
    rows += [(1201, draw(1, 3), 1, *clash), (1202, draw(1, 3), 2, *clash), (-100, draw(1), 3, *clash), (-7, draw(1), 9, *clash)]
    rows += [(1300, None, 1, *clash), (1301, draw(1), None, *clash), (None, draw(1), 1, *clash), (1302, [None] * 8, 1, *clash)]
    rows += [(1303, [math.nan] + draw(1)[1:], 1, *clash), (1304, [math.inf] + draw(1)[1:], 1, *clash), (1400, [1e30] * 8, 1, *clash)]
    return rows + [rows[0]] * 3 + [rows[100]] * 2 + [(1500, draw(3e3), 2, None, None, None, None, None)]


@pytest.mark.parametrize("small", [False, True])
def test_mined_by_brute_force(spark, small, monkeypatch):
    if small:  # many parts, blocks and buckets
        for name, value in {"PART": 60, "BLOCK": 3, "BUCKET": 16, "CHUNK": 4}.items():
            monkeypatch.setattr(negatives, name, value)
    rows = odd_rows()
    assert got(negatives.mined(table(spark, rows).repartition(5))) == by_hand(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0], 1, "", 1, 1.0, 1.0, 1), (1, [0.9, 0.1], 2, "", 1, 1.0, 1.0, 1), (2, [1.0, 0.1], 2, "", 1, 1.0, 1.0, 1)]
    assert got(negatives.mined(table(spark, rows))) == by_hand(rows)
    assert got(negatives.mined(table(spark, rows).limit(0))) == set()


def test_all_labels_alike(spark):
    rows = [(at, [1.0, at / 100], 3 if at % 7 else 2, "", 1, 1.0, 1.0, 1) for at in range(50)]
    assert got(negatives.mined(table(spark, rows))) == by_hand(rows) == set()


def part_of(vectors, labels):
    x = [np.floor(256 * v).astype(np.int64) for v in vectors]
    lengths = [float(np.sqrt((v * v).sum())) for v in x]
    return pd.DataFrame({"x": x, "label": labels, "length": lengths, "ids": [np.array([at]) for at in range(len(x))]})


def test_candidates_hold_all_that_reach_the_bound():
    random_ = np.random.default_rng(3)
    points = part_of(random_.standard_normal((2000, 16)), np.zeros(2000, dtype=int))
    anchors = negatives.Anchors(np.stack(points["x"][:40]), np.zeros(40, dtype=int), np.zeros(40, dtype=np.int64))
    exact = np.stack(points["x"]) @ np.stack(points["x"][:40]).T
    anchors.low = np.sort(exact, axis=0)[-6]
    for bucket in negatives.Part(points).buckets:
        at, row, score, _ = negatives.scored(anchors, np.arange(40), bucket, True)
        wanted = {(a, s) for a in range(40) for s in (bucket.vectors @ anchors.vectors[a]) if s >= anchors.low[a]}
        assert {(a, s) for a, s in zip(at, score)} == wanted


def test_ranges_spare_most_of_clustered_vectors(monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET", 128)
    random_ = np.random.default_rng(6)
    centres = random_.standard_normal((200, 8)) * 3
    vectors = centres[random_.integers(0, 200, 8000)] + random_.standard_normal((8000, 8)) * 0.05
    points = part_of(vectors, np.arange(8000) % 2)
    exact = np.stack(points["x"]) @ np.stack(points["x"][:100]).T
    alike = np.where((points["label"].to_numpy() % 2)[:, None] == np.arange(100) % 2, exact, negatives.LEAST)
    sixth = np.sort(alike, axis=0)[-6]
    for bound, share in ((np.full(100, negatives.LEAST), 0.6), (sixth * 99 // 100, 0.15)):
        part, found = negatives.Part(points), negatives.Found(100, 6)
        anchors = negatives.Anchors(np.stack(points["x"][:100]), np.arange(100) % 2, bound)
        part.search(anchors, True, found)
        assert part.scored < share * 100 * 8000, part.scored
        for a in range(100):
            assert sorted(found.rows[1][found.rows[0] == a]) == sorted(alike[:, a])[-6:]


def test_short_rows_are_passed_over():
    random_ = np.random.default_rng(8)
    vectors = random_.standard_normal((6000, 16)) * np.repeat([10.0, 0.1], 3000)[:, None]
    part, found = negatives.Part(part_of(vectors, np.zeros(6000, dtype=int))), negatives.Found(20, 6)
    anchors = negatives.Anchors(np.floor(256 * vectors[:20]).astype(np.int64), np.zeros(20, dtype=int), np.full(20, negatives.LEAST))
    part.search(anchors, True, found)
    assert part.scored <= 20 * 3 * negatives.BUCKET
