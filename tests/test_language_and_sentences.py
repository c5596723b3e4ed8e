import random
import re

import pytest

from factloom.functions.language import detect_language
from factloom.functions.sentences import protect_urls, restore_urls, split_sentences, urls_in
from factloom.operators.segments import with_language
from factloom.operators.translation import extend_memory, translate


@pytest.mark.parametrize(
    "text, language, confidence",
    [
        ("Reservoir levels rose 3.75% overnight.", "en", 0.99),
        ("వరంగల్ లో వర్షాలు మొదలయ్యాయి నేడు", "te", 0.99),
        ("Mayor Rao వరంగల్కి వెళ్లారు.", "mixed", 0.98),
        ("FERRY TIMES వరంగల్", "mixed", 0.98),
        ("Ox", "en", 0.8),
        ("కా", "te", 0.8),
        ("", "en", 0.0),
        (None, "en", 0.0),
        (" \n", "en", 0.0),
        ("2031 44 7", "en", 0.5),
        ("http://ferry.example/t", "en", 0.99),
        ("klmnopqrst కా", "en", 0.958),
        ("k కా", "te", 0.917),
        ("ab కక", "en", 0.875),
    ],
)
def test_detection(apply, text, language, confidence):
    assert tuple(apply(detect_language, [text])[0]) == (language, confidence)


def test_staged_detection_agrees(spark, apply):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab క్1 .") for _ in range(rng.randrange(40))) for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "at int, text string")
    staged = sorted(with_language(frame, "text").drop("text").collect())
    assert [tuple(r)[1:] for r in staged] == [tuple(r) for r in apply(detect_language, texts)]


def sentences_of(text):
    """The splitting rule over alternating stretches and end marks."""
    found, at = [], 0
    for end in re.finditer(r"[.?!।\n]+(?:\s+|$)", text):
        body, whole = text[at : end.start()], text[at : end.end()]
        found.append((body if re.search(r"[.?!।\n]", body) else whole).strip())
        at = end.end()
    found.append(text[at:].strip())
    kept = [s for s in found if any(c.isalnum() for c in s)]
    return kept or ([text.strip()] if text else [])


def test_sentences(apply):
    cases = [
        "Up 3.75% today. Later.",
        "Left. Right? Up! కింద। on",
        "a\ufdd0b c. d\ufdd0.\ufdd0 e",
        "a\nb\n c",
        "...",
        "",
        "  ",
    ]
    rng = random.Random(11)
    cases += ["".join(rng.choice("ab .?!\n।1క \ufdd0") for _ in range(rng.randrange(16))) for _ in range(1500)]
    got = apply(split_sentences, cases)
    assert got[0] == ["Up 3.75% today", "Later."]
    assert got[1] == ["Left.", "Right?", "Up!", "కింద।", "on"]
    assert got[2] == ["a\ufdd0b c.", "d\ufdd0.\ufdd0 e"]
    assert got == [sentences_of(case) for case in cases]


def test_url_masks(apply):
    texts = ["See https://a.b/c and WWW.x.y, https://a.b end", "none", "www.a", " ".join(f"www.{n}" for n in range(12))]
    masked = apply(protect_urls, texts)
    assert masked[0] == "See __PROTECTED_URL_0__ and __PROTECTED_URL_1__ __PROTECTED_URL_2__ end"
    assert masked[1] == "none"
    assert masked[3].endswith("__PROTECTED_URL_11__")
    assert apply(lambda c: restore_urls(protect_urls(c), urls_in(c)), texts) == texts


MEMORY = [
    ("వరంగల్ లో వర్షాలు మొదలయ్యాయి.", "Rains began in Warangal."),
    ("చూడండి __PROTECTED_URL_0__", " See __PROTECTED_URL_0__ now "),
]


def memory_table(spark, rows=MEMORY):
    return spark.createDataFrame(rows, "source_sentence string, translated string")


def test_translation(spark):
    texts = [
        "Reservoirs stand at 7.2 metres.",
        "వరంగల్ లో వర్షాలు మొదలయ్యాయి. It is good. చూడండి https://a.b/c",
        "తెలియదు.",
        "  ",
        None,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = translate(frame, ["id"], "text", memory_table(spark)).collect()
    got = {r.id: (r.translated_text, r.sentences_translated, r.sentences_skipped, r.was_translated) for r in rows}
    assert got == {
        0: ("Reservoirs stand at 7.2 metres.", 0, 1, False),
        1: ("Rains began in Warangal. It is good. See https://a.b/c now", 2, 1, True),
        2: ("తెలియదు.", 1, 0, True),
        3: ("", 0, 0, False),
        4: ("", 0, 0, False),
    }


def test_model_sees_each_unknown_sentence_once(spark):
    frame = spark.createDataFrame([(1, "కొత్త. English here."), (2, "కొత్త."), (3, MEMORY[0][0])], "id int, text string")

    def make_translator():
        return lambda sentences: sentences.map(lambda s: f"[{s}]")

    memory = extend_memory(frame, "text", memory_table(spark), make_translator)
    fresh = [r.translated for r in memory.collect() if r.translated.startswith("[")]
    assert fresh == ["[కొత్త.]"]
    rows = translate(frame, ["id"], "text", memory).collect()
    assert {r.id: r.translated_text for r in rows}[1] == "[కొత్త.] English here."
