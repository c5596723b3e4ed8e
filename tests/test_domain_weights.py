"""Learned domain weights against plain Python."""

import math
import random
import re
from collections import Counter

from factloom.operators import domain_weights
from factloom.operators.domains import DOMAINS

TALK = {
    "Medical": "nurse clinic dose fever trial", "Politics": "senate vote ballot mayor treaty",
    "Finance": "bond loan yield bank audit", "Technology": "chip server code robot patch", "Unknown": "rain match goal song film",
}


def claims(n, seed):
    chance, rows = random.Random(seed), []
    for at in range(n):
        name = chance.choice(DOMAINS)
        own = [chance.choice(TALK[name].split()) for _ in range(3)]
        rest = [chance.choice(chance.choice(list(TALK.values())).split()) for _ in range(1)]
        rows.append((at, " ".join([*own, *rest, "the", "The", f"n{seed}x{at}"]), name))
    return rows


def by_hand(taught, asked, prior=100.0):
    words = lambda text: set(re.findall("[a-z0-9]+", (text or "").lower()))
    good = [(words(text), label) for _, text, label in taught if label in DOMAINS and words(text)]
    count = {d: Counter(w for ws, label in good if label == d for w in ws) for d in DOMAINS}
    every, shares = sum(count.values(), Counter()), Counter(label for _, label in good)
    total = sum(every.values())
    out = {}
    for key, text, *_ in asked:
        known = [w for w in words(text) if w in every]
        scores = []
        for d in DOMAINS:
            if not shares[d]:
                continue
            mine, score = sum(count[d].values()), math.log(shares[d] / len(good))
            for w in known:
                a, y = prior * every[w] / total, count[d][w]
                if mine != total:
                    score += math.log((y + a) / max(mine + prior - y - a, 1e-9)) - math.log((every[w] - y + a) / max(total - mine + prior - every[w] + y - a, 1e-9))
            scores.append((score, d))
        if not known or not scores:
            out[key] = ("Unknown", 0.0)
            continue
        top = max(s for s, _ in scores)
        out[key] = (next(d for s, d in scores if s == top), 1 / sum(math.exp(s - top) for s, _ in scores))
    return out


def run(spark, taught, asked):
    frame = lambda rows: spark.createDataFrame(rows, "claim_id long, claim string, label string")
    found = domain_weights.classify(frame(asked), *domain_weights.word_weights(frame(taught)))
    return {r["claim_id"]: (r["domain"], r["confidence"]) for r in found.collect()}


def same(a, b):
    return a.keys() == b.keys() and all(a[k][0] == b[k][0] and math.isclose(a[k][1], b[k][1], abs_tol=1e-9) for k in a)


def test_equals_plain_recomputation_and_holds_out(spark):
    taught, asked = claims(400, 1), claims(300, 2)
    odd = [(900, None, "Medical"), (901, "", "Finance"), (902, "loan", None), (903, "loan", "Sport"), (904, "... !", "Finance"), (905, "LOAN loan", "Finance")]
    found = run(spark, taught + odd, asked + odd + [(999, "words never seen", None)])
    assert same(found, by_hand(taught + odd, asked + odd + [(999, "words never seen", None)]))
    assert found[999] == found[900] == ("Unknown", 0.0)
    assert sum(found[key][0] == label for key, _, label in asked) > 0.9 * len(asked)


def test_few_labels(spark):
    asked = claims(5, 3)
    assert set(run(spark, [(1, "x", None)], asked).values()) == {("Unknown", 0.0)}
    for taught in ([(1, "the bond", "Finance")], [(1, "the", "Finance"), (2, "the", "Medical")]):
        assert same(run(spark, taught, asked), by_hand(taught, asked))


def test_quality(spark):
    rows = [("Finance", "Finance"), ("Finance", "Medical"), ("Medical", "Medical"), ("Politics", "Medical")]
    got = {r["domain_name"]: r for r in domain_weights.quality(spark.createDataFrame(rows, "domain string, expected_domain string")).collect()}
    assert (got["Medical"]["claims"], got["Medical"]["precision"], got["Medical"]["recall"]) == (3, 1.0, 0.3333)
    assert (got["Politics"]["claims"], got["Politics"]["precision"], got["Politics"]["recall"]) == (0, 0.0, None)


def test_frequent_words_are_not_dealt_by_word(spark):
    """What every claim says is joined where the claims are; its rows reach no exchange on words."""
    frame = spark.createDataFrame([(at, f"the bond n{at}", "Finance") for at in range(3000)], "claim_id long, claim string, label string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weights, shares = domain_weights.word_weights(frame)
        assert {row["word"] for row in weights.filter("often").collect()} == {"the", "bond"}
        plan = domain_weights.classify(frame, weights, shares)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin [word" in plan
