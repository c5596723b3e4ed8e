"""Central sentences: scores against a plain walk over a dictionary, choice, odd texts."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from factloom.functions.centrality import scores
from factloom.operators.claims import central_claims, choose_claim


def plain(sentences):
    """Scores by dictionaries: chains of the holders of each rare word, ten rounds."""
    most = max(2, len(sentences) // 5)
    links = []
    for word in {word for held in sentences for word in held}:
        at = [n for n, held in enumerate(sentences) if word in held]
        if len(at) <= most:
            links += [pair for a, b in zip(at, at[1:]) for pair in ((a, b), (b, a))]
    degree = [sum(a == n for a, _ in links) for n in range(len(sentences))]
    now = [1_000_000] * len(sentences)
    for _ in range(10):
        after = [150_000] * len(sentences)
        for a, b in links:
            after[b] += now[a] * 85 // (100 * degree[a])
        now = after
    return now


def test_scores_equal_a_plain_walk():
    draw = random.Random(5)
    for _ in range(60):
        sentences = [set(draw.sample(range(40), draw.randint(0, 8))) for _ in range(draw.randint(0, 25))]
        words = np.array([word for held in sentences for word in held], dtype=np.int64)
        sizes = np.array([len(held) for held in sentences], dtype=np.int64)
        assert scores(words, sizes).tolist() == plain(sentences)


def test_very_long_texts_stay_linear():
    draw = np.random.default_rng(3)
    sizes = np.full(200_000, 12)
    words = draw.integers(0, 300_000, sizes.sum())
    words[::12] = -1  # one word in every sentence links none of them
    started = time.time()
    found = scores(words, sizes)
    assert time.time() - started < 30 and len(found) == 200_000 and found.min() >= 150_000


def claims_of(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "at int, text string")
    rows = central_claims(frame, F.col("text")).orderBy("at").collect()
    return [(row["claim"], row["centrality"]) for row in rows]


def test_choice(spark):
    hub = "The council approved the harbour bridge and the northern tunnel"
    text = (
        f"Birds sang all day. Engineers praised the harbour project. {hub}. "
        "Drivers await the northern section. A cat slept."
    )
    (claim, score), *_ = claims_of(spark, [text])
    assert claim.rstrip(".") == hub and score > 1_000_000


def test_equals_fall_back_on_the_claim_like_and_the_earliest(spark):
    told = "Output rose by 12 % in Hyderabad during the spring of the last year"
    assert claims_of(spark, [f"Nothing here. {told}. Quite so."])[0][0].rstrip(".") == told
    assert claims_of(spark, ["One thing. Two thing."])[0][0] == "One thing."


def test_odd_texts(spark):
    assert claims_of(spark, [None, "", " \n ", "!!!"]) == [("", None), ("", None), ("", None), ("!!!", 150_000)]
    empty = spark.createDataFrame([], "at int, text string")
    assert central_claims(empty, F.col("text")).count() == 0


def test_mode_central(spark):
    frame = spark.createDataFrame([(1, "A fact. A fact again.", "")], "claim_id int, text string, processed_text string")
    row = choose_claim(frame, "central").first()
    assert row["claim"] == "A fact." and "centrality" in row.asDict()
