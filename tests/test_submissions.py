"""Submissions end to end, on batch and stream."""

import pytest
from pyspark.sql import functions as F

from factloom.operators.claims import clean_claim, claim_list, extract_claim
from factloom.plans.submission_flow import claims_and_domains, process_submissions
from factloom.sources.replies import score_prompts
from factloom.sources.schemas import OCR_BLOCKS, SUBMISSIONS, TRANSLATION_MEMORY
from factloom.sources.submissions import read_submissions, reject_reason, stream_submissions
from factloom.streaming.flows import per_batch, text_stream, write_stream

TELUGU = "వరంగల్ లో వర్షాలు మొదలయ్యాయి."
ROWS = [
    (1, "The harbour bank set its repo rate at 3.75% on Monday.", None),
    (2, TELUGU, None),
    (3, "Verify this breaking news:", "te"),
    (4, None, "en"),
    (5, "  ", ""),
    (6, "has text", "gone"),
    (7, " @@@ ## ", None),
    (8, "seen before", "blank"),
    (9, None, "blank"),
    (10, "Mayor Rao వరంగల్ కి వెళ్లారు and opened two new bridges.", "en"),
]


def box(x, y):
    return [(x, y), (x + 9.0, y), (x + 9.0, y + 9.0), (x, y + 9.0)]


@pytest.fixture(scope="module")
def tables(spark):
    blocks = [
        ("te", 0, box(0.0, 0.0), TELUGU, 0.9),
        ("en", 0, box(50.0, 0.0), "NEWS ^^", 0.2),
        ("en", 1, box(0.0, 0.0), "BREAKING", 0.3),
        ("blank", 0, box(0.0, 0.0), "  ", 0.9),
    ]
    memory = [(TELUGU, "Rains began in Warangal.")]
    return {
        "submissions": spark.createDataFrame(ROWS, SUBMISSIONS),
        "images": spark.createDataFrame([("te",), ("en",), ("blank",)], "image_id string"),
        "blocks": spark.createDataFrame(blocks, OCR_BLOCKS),
        "memory": spark.createDataFrame(memory, TRANSLATION_MEMORY),
    }


@pytest.fixture(scope="module")
def processed(tables):
    return process_submissions(**tables).cache()


def test_processed_rows(processed):
    rows = {r.submission_id: r for r in processed.collect()}
    assert len(rows) == len(ROWS)
    assert rows[1].processed_text == ROWS[0][1]
    assert (rows[1].original_language, rows[1].was_translated) == ("en", False)
    assert rows[2].processed_text == "Rains began in Warangal."
    assert rows[2].pre_translation_text == TELUGU
    assert (rows[2].original_language, rows[2].translated_segments) == ("te", 1)

    both = rows[3]
    assert [s.source for s in both.segments] == ["user_text", "ocr"]
    assert [s.translated_text for s in both.segments] == [None, "Rains began in Warangal."]
    assert both.processed_text == "Verify this breaking news:\nRains began in Warangal."
    assert (both.original_language, both.language_confidence) == ("mixed", 0.99)
    assert both.ocr_confidence == both.segments[1].ocr_confidence == 0.9

    image = rows[4]
    assert [(s.order, s.source) for s in image.segments] == [(0, "ocr")]
    assert image.processed_text == "BREAKING NEWS"
    assert image.quality_flags == [
        "low_average_ocr_confidence", "multiple_low_confidence_blocks", "ocr_symbol_noise_cleaned",
    ]
    assert rows[8].quality_flags == ["empty_ocr_result", "empty_ocr_text"]
    assert (rows[8].original_language, len(rows[8].segments)) == ("en", 1)
    assert rows[10].original_language == "mixed"
    assert rows[10].was_translated is True


def test_fallback_rows(processed):
    rows = {r.submission_id: r for r in processed.filter(F.size("errors") > 0).collect()}
    assert {key: row.errors[0] for key, row in rows.items()} == {
        5: "Neither text nor image was provided.",
        6: "Provided image path does not exist: gone",
        7: "No usable text was extracted from inputs.",
        9: "No usable text was extracted from inputs.",
    }
    assert rows[6].processed_text == "has text"
    assert rows[5].had_text is True and rows[9].had_text is False
    assert all(row.quality_flags == ["input_processing_error"] and row.segments == [] for row in rows.values())


def test_reject_reason_agrees(tables, processed):
    early = reject_reason(tables["submissions"], tables["images"]).filter("reason is not null")
    assert {r.submission_id for r in early.collect()} == {5, 6}


def test_claim_and_domain_without_model(processed):
    row = claims_and_domains(processed).filter("submission_id = 1").first()
    assert row.claim == ROWS[0][1].rstrip(".")  # a sentence with a decimal loses its end mark
    assert (row.domain, row.reason) == ("Finance", "matched: bank, rate, repo")


def test_claim_and_domain_from_replies(spark, processed):
    replies = spark.createDataFrame(
        [
            ("claim", 1, 1, 1, 'Claim: "RBI cut  the rate."'),
            ("domain", 1, 1, 1, '```json\n{"domain": "Finance", "confidence": 0.9, "reason": "rates"}\n```'),
            ("domain", 2, 1, 1, "no idea"),
        ],
        "stage string, claim_id bigint, attempt_no int, try_no int, raw string",
    )
    rows = {r.submission_id: r for r in claims_and_domains(processed, replies).collect()}
    assert (rows[1].claim, rows[1].domain, rows[1].confidence, rows[1].errors) == ("RBI cut the rate.", "Finance", 0.9, [])
    assert rows[2].claim == "Rains began in Warangal."
    assert rows[2].errors == ["claim_extraction_error: no model reply"]
    assert (rows[2].domain, rows[2].reason) == ("Unknown", "Invalid JSON returned by LLM.")
    assert rows[8].errors == ["claim_extraction_error: no model reply", "domain_detection_error: no model reply"]
    assert (rows[9].claim, rows[9].reason) == ("", "No claim available for domain detection.")


@pytest.mark.parametrize(
    "raw, claim",
    [
        ("Claim: Main Claim: x", "x"),
        ("Main Claim: Claim: x", "Claim: x"),
        (' OUTPUT: "1. a  b\n c" ', "a b c"),
        ("'q'", "q"),
        ("1.5 percent", "5 percent"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean_claim(apply, raw, claim):
    assert apply(clean_claim, [raw]) == [claim]
    assert apply(lambda c: claim_list(clean_claim(c)), [raw]) == [[claim] if claim else []]


PARAGRAPHS = [
    "The harbour authority opened a second ferry line on 4 May.\nUntil now one boat had crossed the bay every 90 minutes. "
    "Fares stay\nas they were for the first year. Shop owners on the far shore\nhope that more guests will come.",
    "Engineers at VIGIL switched on a tide turbine off the Northern\nSkerries last week. It should feed 1,200 homes "
    "before winter.\nOld cables had to be replaced along the whole coast. Nobody knows\nyet how seals will take to it.",
    "",
]


def test_extractive_claim(apply):
    claims = apply(extract_claim, PARAGRAPHS)
    for text, claim in zip(PARAGRAPHS[:2], claims):
        assert claim and len(claim) < len(text) / 2
        assert claim in " ".join(text.split())
    assert "VIGIL" in claims[1] or "1,200" in claims[1]
    assert claims[2] == ""


def test_streamed_text_equals_batch(spark, tables, tmp_path):
    source = str(tmp_path / "in")
    tables["submissions"].repartition(3).write.parquet(source)
    stream = text_stream(stream_submissions(spark, source))
    query = write_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), availableNow=True)
    query.awaitTermination(120)
    batch = text_stream(tables["submissions"])
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select(batch.columns).collect(), key=lambda r: r[0]) == sorted(
        batch.collect(), key=lambda r: r[0]
    )


def test_batches_of_a_stream_run_table_operators(spark, tables, tmp_path):
    source = str(tmp_path / "in")
    tables["submissions"].write.parquet(source)
    others = {name: table for name, table in tables.items() if name != "submissions"}
    query = per_batch(
        stream_submissions(spark, source), lambda batch: process_submissions(batch, **others),
        str(tmp_path / "out"), str(tmp_path / "check"), availableNow=True,
    )
    query.awaitTermination(240)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ROWS)


def test_scorer_is_made_once_per_task(spark):
    prompts = spark.range(100).select(F.col("id"), F.concat(F.lit("p"), F.col("id")).alias("prompt")).coalesce(1)

    def make():
        state = {"made": 1}
        return lambda batch: batch.map(lambda p: f"{p}:{state['made']}")

    rows = score_prompts(prompts, make).collect()
    assert {r.raw for r in rows} == {f"p{n}:1" for n in range(100)}


def test_submissions_are_read_by_schema(spark, tmp_path):
    """Absent columns are null, others are left out, whatever the format."""
    rows = [(1, "a text", None, "x"), (2, None, "img", "y")]
    frame = spark.createDataFrame(rows, "submission_id long, text string, image_id string, more string")
    frame.write.parquet(str(tmp_path / "p"))
    frame.drop("image_id").write.json(str(tmp_path / "j"))
    got = read_submissions(spark, str(tmp_path / "p"))
    assert got.columns == ["submission_id", "text", "image_id"]
    assert sorted(map(tuple, got.collect())) == [row[:3] for row in rows]
    assert sorted(map(tuple, read_submissions(spark, str(tmp_path / "j"), "json").collect())) == [
        (1, "a text", None), (2, None, None),
    ]
