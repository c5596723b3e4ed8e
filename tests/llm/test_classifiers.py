import random

import numpy as np
import pytest

from factloom.llm import langid, quality, toxicity

from .conftest import held


def forest_by_hand(forest, row):
    total = forest.start
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(row[int(feature[node])] > threshold[node])
        total += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_trees_learn_and_flat_arrays_walk_like_trees():
    chance = np.random.default_rng(5)
    rows = chance.normal(size=(3000, 6))
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 3] < -0.2)).astype(float)
    forest = quality.grow(rows[:2000], labels[:2000], np.ones(2000))
    scores = forest.score(rows)
    assert ((scores[2000:] > 0.5) == labels[2000:]).mean() > 0.97
    for at in range(0, 3000, 97):
        assert scores[at] == pytest.approx(forest_by_hand(forest, rows[at]), abs=1e-12)


def test_one_class_gives_its_share():
    forest = quality.grow(np.zeros((4, 2)), np.ones(4), np.ones(4))
    assert forest.score(np.zeros((2, 2))).tolist() == pytest.approx([0.999, 0.999], abs=1e-3)
    assert quality.grow(np.zeros((0, 2)), np.zeros(0), np.zeros(0)).score(np.zeros((1, 2)))[0] == 0.5


@pytest.mark.parametrize("operator, divisor, value, threshold", [(quality, 5, 0, 0.3), (toxicity, 3, 1, 0.7)])
def test_every_document_has_one_result(odd_documents, odd_labels, no_documents, no_labels, operator, divisor, value, threshold):
    rows = operator.predictions(odd_documents, odd_labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd_documents.select("doc_id").collect())
    for row in rows:
        assert row["held_out"] == held(row["doc_id"], divisor, value)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= threshold)
    assert operator.predictions(no_documents, odd_labels).collect() == []
    assert operator.predictions(odd_documents, no_labels).count() == len(rows)


def corpus(spark, seed, size=1200):
    chance = random.Random(seed)
    clean = [f"{a}{b}" for a in ("wi", "ta", "no", "re", "lu") for b in ("ster", "bling", "moor", "dan", "kett")]
    bad = ["grobnik", "schlurp", "vexolan", "vexolor", "vexoling"]
    rows, labels = [], []
    for at in range(size):
        words = [chance.choice(clean) for _ in range(chance.randint(8, 120))]
        toxic = at % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(chance.randint(0, len(words)), chance.choice(bad))
        rows.append((at, " ".join(words)))
        labels.append((at, 1, int(toxic)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {row[0]: row[2] for row in labels},
    )


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    documents, labels, truth = corpus(spark, 1)
    for row in toxicity.predictions(documents, labels).filter("held_out").collect():
        assert row["predicted"] == truth[row["doc_id"]]
    kept = {row["doc_id"] for row in toxicity.drop_toxic(documents, labels).collect()}
    assert kept == {at for at, toxic in truth.items() if not toxic}


def test_disguised_words_unseen_forms_and_exceptions(spark):
    documents, labels, _ = corpus(spark, 2)
    lexicon = toxicity.learn(documents, labels, exceptions=("grobnik sauce",))
    automaton = lexicon.automaton()
    found = lambda text: toxicity.measures(toxicity.fold(text), automaton)[0] > 0
    for text in ("GROBNIK!", "gr0bn1k", "gгоbnіk", "ｇｒｏｂｎｉｋ", "gröbnik", "$chlurp $$$", "vexolistan", "gro​bnik."):
        assert found(f"wister {text} taster")
    for text in ("wister grobnik sauce", "a gro bnik", "no vex", "wister$$$ taster!!"):
        assert not found(text)


def test_words_that_long_clean_texts_hold_by_chance_are_learned(spark):
    chance = random.Random(11)
    word = lambda: "".join(chance.choice(["lo", "ra", "mi", "ten", "sa", "vu", "ko"]) for _ in range(4))
    usual, bad = [word() for _ in range(300)], ["gnarplich", "gnarplicher", "gnarplichung"]
    rows, labels = [], []
    for at in range(1200):
        toxic = at % 8 == 0
        words = [chance.choice(usual) for _ in range(120 if toxic else 900)]
        # As many clean documents as toxic ones hold a bad word, but once in a long text.
        for _ in range(6 if toxic else at % 7 == 1):
            words.insert(chance.randint(0, len(words)), chance.choice(bad))
        rows.append((at, " ".join(words)))
        labels.append((at, 1, int(toxic)))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.learn(documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert " gnarpli" in lexicon.weights and not any(term.startswith(f" {w[:4]}") for w in usual for term in lexicon.weights)
    truth = {row[0]: row[2] for row in labels}
    for row in toxicity.predictions(documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect():
        assert row["predicted"] == truth[row["doc_id"]]


def test_fold_keeps_one_space_around_words():
    assert toxicity.fold(None or "") == "  "
    assert toxicity.fold("Ein\tWort,\n 1d10t") == " ein wort idiot "


def test_tail_is_the_binomial_tail():
    from math import comb, exp

    for hits, rows, share in ((3, 5, 0.2), (0, 4, 0.5), (7, 7, 0.1)):
        plain = sum(comb(rows, k) * share**k * (1 - share) ** (rows - k) for k in range(hits, rows + 1))
        assert exp(toxicity.tail(hits, rows, share)) == pytest.approx(plain)


def test_ratio_of_rates():
    assert toxicity.ratio(0, 0, 10, 1000) == pytest.approx(0)
    assert toxicity.ratio(8, 800, 10, 1000) == pytest.approx(0)
    assert toxicity.ratio(80_000, 80_000, 10, 1000) == pytest.approx(np.log(100), abs=1e-3)


def test_quality_keeps_columns(odd_documents, odd_labels):
    assert quality.keep_good(odd_documents, odd_labels).columns == odd_documents.columns
    assert toxicity.drop_toxic(odd_documents, odd_labels).columns == odd_documents.columns


def test_languages(spark):
    chance = random.Random(6)
    syllables = {"aa": ["ka", "mo", "ti"], "bb": ["schu", "ner", "gra"], "cc": ["ño", "lla", "cue"]}
    word = lambda lang: "".join(chance.choice(syllables[lang]) for _ in range(chance.randint(1, 4)))
    truth, rows = {}, []
    for at in range(900):
        lang = "abc"[at % 3] * 2
        truth[at] = lang
        rows.append((at, " ".join(word(lang) for _ in range(chance.randint(1, 40))), lang if at % 10 else None))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 ?!", "bb")]
    found = langid.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == len(rows)
    for row in found:
        assert row["held_out"] == held(row["doc_id"], 4, 2) and 0 <= row["score"] <= 1
        assert row["lang_pred"] == truth.get(row["doc_id"], "und")


def test_backoff_takes_the_longest_known_grams():
    grams = {" a": 0, "ab": 1, "a": 2, "abc": 3, "b": 4, "c": 5}
    model = langid.Model(("x",), {}, np.zeros((0, 1)), grams, np.arange(6.0)[:, None])
    # " abd ": " a" at 0, "ab" at 1, "b" at 2; "d" and the last space are unknown.
    assert model.unseen("abd")[0] == pytest.approx((0 + 1 + 4) / 3)
    assert model.unseen("zz")[0] == 0.0


def test_languages_of_odd_documents(odd_documents, no_documents):
    rows = langid.predictions(odd_documents).collect()
    assert len(rows) == odd_documents.count() and {r["lang_pred"] for r in rows} <= {"en", "de", "und"}
    assert langid.predictions(no_documents).collect() == []
    teaching_nothing = odd_documents.selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert {r["lang_pred"] for r in langid.predictions(teaching_nothing).collect()} == {"und"}


def test_exception_phrases_equal_a_walk_over_all_and_stay_linear():
    import random
    import time

    draw = random.Random(2)
    for _ in range(300):
        places = {draw.randint(0, 60) for _ in range(draw.randint(0, 20))}
        ranges = [(start, start + draw.randint(0, 15)) for start in draw.choices(range(60), k=draw.randint(0, 8))]
        plain = {at for at in places if any(start <= at < end for start, end in ranges)}
        assert set(toxicity.covered(places, ranges)) == plain
    automaton = toxicity.Lexicon({" idiot ": 1.0}, (" no idiot ",), (0.0,) * 4).automaton()
    started = time.time()
    assert toxicity.measures(toxicity.fold("no idiot " * 200_000), automaton) == (0.0, 0.0, 0.0)
    assert toxicity.measures(toxicity.fold("no idiot " * 200_000 + "idiot"), automaton)[2] == 1.0
    assert time.time() - started < 20
