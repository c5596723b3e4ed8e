"""Normalisation and cleaning: literal cases, and random texts against small models."""

import random
import re
import unicodedata

import pytest

from factloom.functions import text as tx
from factloom.operators.cleaning import clean, flag_counts, kept_lines

TELUGU = "వర్షాలు మొదలయ్యాయి"


def pieces(seed, alphabet, count=600, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(count)]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Reservoir levels rose 3.75% .", "Reservoir levels rose 3.75% ."),
        ("Mayor Rao వరంగల్ కి వెళ్లారు .", "Mayor Rao వరంగల్ కి వెళ్లారు."),
        ("Goal!!!!!  again ????", "Goal! again ?"),
        ("Tickets: € 12.40 or £ 9 until 2031-01-02 18:45 h .", "Tickets: €12.40 or £9 until 2031-01-02 18:45 h."),
        ("Read http://ferry.example/t?from=a&to=b today .", "Read http://ferry.example/t?from=a&to=b today."),
        ("humidity near 88 % inland", "humidity near 88% inland"),
        ("  wide      gaps    here ", "wide gaps here"),
        ("0 . 50 and 1 . 2 . 3", "0.50 and 1.2.3"),
        ("in 2020, 5 men", "in 2020,5 men"),
        ("what!? no?!", "what? no!"),
        ("wait......... -- ok", "wait... -- ok"),
        ("a\r\nb\tc d﻿​e", "a b c de"),
        ("", ""),
        (None, ""),
        ("  \n\t ", ""),
    ],
)
def test_normalize_cases(apply, given, wanted):
    assert apply(tx.normalize_text, [given]) == [wanted]


def test_composition(apply):
    decomposed = unicodedata.normalize("NFD", TELUGU + " café")
    assert apply(tx.normalize_text, [decomposed]) == [unicodedata.normalize("NFC", TELUGU + " café")]


# The rules of normalisation, in order (fixed values).
RULES = [
    ("\r\n|[\r\n\t]", " "),
    ("[\ufeff\u200b]", ""),
    ("\u00a0", " "),
    (r"(?<=\d)\s*([.,])\s*(?=\d)", r"\1"),
    (r"(?<=[₹$€£¥])\s+(?=\d)", ""),
    (r"(?<=\d)\s+(?=[%％])", ""),
    (r"(?<=[a-zA-Z\u0C00-\u0C7F)\]'\"])\s+(?=[.,!?;:](\s|$))", ""),
    (r"[!?]+([!?])", r"\1"),
    (r"\.{4,}", "..."),
    (r"\s+", " "),
]


def normal_form(text):
    """The normalisation rules one after the other."""
    text = unicodedata.normalize("NFC", text)
    for pattern, replacement in RULES:
        text = re.sub(pattern, replacement, text)
    return text.strip()


def test_normalize_random(apply):
    texts = pieces(1, "a5 \n\t .,!?%$₹:)\"é́ ​\x1c క్", 1500)
    assert apply(tx.normalize_text, texts) == [normal_form(text) for text in texts]


#: Tokens of symbols, worked out by hand from the rule.
STAYS = """
    . , ! ? ; : ' " - – — ( ) [ ] { } + % $ ₹ € * & < = > / .. ... !! !!! ?? ??? -- --- ==
    ., !? ?! (-) ["'] {;} .... !!!! ---- –— ") a@ #tag x| ~5 é^ క్# 1` _a_
""".split()
GOES = """
    @ # ^ ~ | \\ _ ` @@ ## @. !# ?_? ~~~ (^) *** && <> => >= ++ %% $$ ₹₹ -> .* =! -= ,+, €- =.=
""".split()


def test_noise_tokens_one_by_one(apply):
    assert apply(tx.drop_noise_tokens, STAYS) == STAYS
    assert apply(tx.drop_noise_tokens, GOES) == [""] * len(GOES)


def test_noise_tokens_in_random_texts(apply):
    rng = random.Random(2)
    texts, wanted = [], []
    for _ in range(1500):
        tokens = [rng.choice(STAYS + GOES) for _ in range(rng.randrange(8))]
        gaps = [rng.choice([" ", "\n", " \t", "  "]) for _ in range(len(tokens) + 1)]
        join = lambda words: gaps[0] + "".join(w + g for w, g in zip(words, gaps[1:]))  # noqa: B023, E731
        texts.append(join(tokens))
        wanted.append(join(["" if token in GOES else token for token in tokens]))
    assert apply(tx.drop_noise_tokens, texts) == wanted


def without_repeats(lines, key):
    kept, last = [], None
    for line in lines:
        if line and key(line) == last:
            continue
        last = key(line) if line else last
        kept.append(line)
    return "\n".join(kept)


def test_repeated_lines_random(apply):
    texts = pieces(3, "aAb \t\n\n", 1000, 24)
    tidy = [[re.sub(r"[ \t]+", " ", line).strip() for line in text.split("\n")] for text in texts]
    wanted = [without_repeats(lines, str.lower) for lines in tidy]
    assert apply(lambda c: tx.drop_repeated_lines(tx.tidy_lines(c)), texts) == wanted
    stripped = [[line.strip() for line in text.split("\n")] for text in texts]
    words = [
        without_repeats(lines, lambda line: re.sub(r"\s+", " ", line).lower()) if len(lines) > 1 else text
        for lines, text in zip(stripped, texts)
    ]
    assert apply(tx.dedupe_lines, texts) == words


def test_relational_repeats_agree(spark, apply):
    texts = pieces(4, "aAb \n\n", 300, 20)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = sorted(kept_lines(frame, "doc_id", "text").collect())
    joined = ["\n".join(r.line for r in rows if r.doc_id == at) for at in range(len(texts))]
    assert joined == apply(lambda c: tx.drop_repeated_lines(tx.tidy_lines(c)), texts)


def test_clean_with_flags(spark):
    texts = [
        "~~ FERRY LATE ## ^ |\nFERRY LATE\nferry late\nBoats leave at noon.",
        "Reservoir levels rose 3.75%.",
        "bell\x07 here",
        "## ~^~ | @?@ _",
        "#ferry @harbour ok",
        None,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "at int, text string")
    cleaned = clean(frame, "text")
    rows = {r.at: (r.cleaned_text, r.quality_flags) for r in cleaned.collect()}
    noise, repeats = "ocr_symbol_noise_cleaned", "repeated_lines_removed"
    assert rows == {
        0: ("FERRY LATE\nBoats leave at noon.", [noise, repeats]),
        1: ("Reservoir levels rose 3.75%.", []),
        2: ("bell here", ["control_characters_removed"]),
        3: ("", [noise]),
        4: ("#ferry @harbour ok", []),
        5: ("", []),
    }
    assert {r.flag: r.rows for r in flag_counts(cleaned).collect()} == {
        noise: 2, repeats: 1, "control_characters_removed": 1,
    }


def test_short_cleaning_equals_full_on_normal_text(spark):
    texts = pieces(5, "a1 \x07@#*.!?\n\t%é", 800, 20)
    frame = spark.createDataFrame(list(enumerate(texts)), "at int, text string")
    from pyspark.sql import functions as F

    normal = frame.withColumn("text", tx.normalize_text(F.col("text")))
    both = [sorted(clean(normal, "text", lines=lines).collect()) for lines in (True, False)]
    assert both[0] == both[1]


def pushed(frame):
    """The filters of all file scans of a plan that read texts."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(PushedFilters: \[[^\]]*\]), ReadSchema: struct<[^>]*text:", plan)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts") / "t")
    rows = [(at, f"Text {at} café !!", None) for at in range(50)]
    spark.createDataFrame(rows, "submission_id long, text string, image_id string").write.partitionBy(
        "submission_id"
    ).parquet(path + "-by-id")
    spark.createDataFrame(rows, "submission_id long, text string, image_id string").write.parquet(path)
    return path


def test_filters_pass_below_normalisation(spark, stored):
    from pyspark.sql import functions as F

    from factloom.operators.segments import with_clean_text

    frame = spark.read.parquet(stored)
    for made in (
        frame.withColumn("text", tx.normalize_text(F.col("text"))),
        with_clean_text(frame, "text"),
    ):
        one = made.filter("submission_id = 3")
        assert all("EqualTo(submission_id,3)" in line for line in pushed(one)) and pushed(one)
        assert one.count() == 1
    parts = spark.read.parquet(stored + "-by-id").withColumn("text", tx.normalize_text(F.col("text")))
    plan = parts.filter("submission_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*= 3\)", plan)


def test_filters_reach_submissions(spark, stored):
    from factloom.plans.submission_flow import process_submissions
    from factloom.sources.schemas import OCR_BLOCKS, TRANSLATION_MEMORY

    none = [
        spark.createDataFrame([], "image_id string"), spark.createDataFrame([], OCR_BLOCKS),
        spark.createDataFrame([], TRANSLATION_MEMORY),
    ]
    one = process_submissions(spark.read.parquet(stored), *none).filter("submission_id = 3")
    assert pushed(one) and all("EqualTo(submission_id,3)" in line for line in pushed(one))
    assert [r.processed_text for r in one.collect()] == ["Text 3 café !"]


def test_composition_of_stretches_equals_whole_texts(apply):
    """Any mix of marks, conjoining letters, compatibility forms and plain text, line feeds included."""
    odd = ["é", "̣", "̇", "ᄀ", "ᅡ", "ᆨ", "가", "Å", "יִ", "\U0002f800", "ె", "ౖ", "్",
           "क़", "\n", "\x00", "a", "ß", "é", "🙂", " ", "ཱ", "ི", "\U0001d15e", "ḋ", "​", " ", "\U00011131", "\U00011127"]
    draw = random.Random(11)
    texts = ["", *odd, *["".join(draw.choice(odd) for _ in range(draw.randint(1, 12))) for _ in range(2000)], None]
    assert apply(tx.compose_unicode, texts) == [text and unicodedata.normalize("NFC", text) for text in texts]


def test_all_other_characters_are_stable(spark):
    """What is not sent to Python neither changes nor joins, for every character that there is."""
    from pyspark.sql import functions as F

    seconds = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    touched = []
    for at in range(0x110000):
        if not 0xD800 <= at < 0xE000:
            parts = unicodedata.decomposition(chr(at)).split()
            if len(parts) == 2 and parts[0][0] != "<":
                seconds.add(int(parts[1], 16))
            if unicodedata.combining(chr(at)) or unicodedata.normalize("NFC", chr(at)) != chr(at):
                touched.append(at)
    frame = spark.createDataFrame([(chr(at),) for at in {*touched, *seconds}], "text string")
    assert frame.filter(~F.col("text").rlike(f"[{tx.UNSTABLE}]")).collect() == []


def test_only_stretches_leave_the_jvm(spark):
    """Of a long text with one mark, a few characters are handed to Python."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([("ü" * 5000 + "é",)], "text string")
    plan = frame.select(tx.compose_unicode(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(text" in plan.split("ArrowEvalPython")[1].split("\n")[0]
