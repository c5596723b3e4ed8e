"""Table schemas, as DDL strings usable with ``spark.read.schema`` and ``readStream``."""

SUBMISSIONS = "submission_id BIGINT, text STRING, image_id STRING"

OCR_BLOCKS = (
    "image_id STRING, block_no BIGINT, box ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, "
    "text STRING, confidence DOUBLE"
)

TRANSLATION_MEMORY = "source_sentence STRING, translated STRING"

CLAIMS = "claim_id BIGINT, claim STRING, domain STRING"

LABELLED_CLAIMS = "claim STRING, expected_domain STRING"

EVIDENCE = (
    "claim_id BIGINT, attempt_no INT, evidence_id STRING, chunk_id STRING, document_id STRING, "
    "text STRING, domain STRING, source STRING, language STRING, retrieved_date TIMESTAMP, "
    "similarity_score DOUBLE, authority_score DOUBLE, retrieval_method STRING, "
    "metadata MAP<STRING, STRING>, url STRING, title STRING, publication_date TIMESTAMP"
)

MODEL_REPLIES = "stage STRING, claim_id BIGINT, attempt_no INT, try_no INT, raw STRING"

#: A segment inside a processed submission.
SEGMENT = (
    "STRUCT<order: INT, source: STRING, original_text: STRING, detected_language: STRING, "
    "language_confidence: DOUBLE, normalized_text: STRING, translated_text: STRING, "
    "ocr_confidence: DOUBLE, quality_flags: ARRAY<STRING>>"
)

#: The one retrieval method the evidence contract allows (fixed value).
RETRIEVAL_METHOD = "faiss_local"
