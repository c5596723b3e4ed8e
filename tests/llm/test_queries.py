"""The registered queries on the smallest tables, and the pipeline against brute force."""

import importlib.util
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import packing, quality, toxicity
from factloom.llm.queries import CHECKS, QUERIES
from tools.compare import compare, database

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_quality": "doc_id held_out score predicted",
    "op4_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op5_neighbours": "query_id rank vec_id score",
    "op6_pieces": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_simhash": "doc_id fingerprint component_id",
    "op8_chat": "conv_id part copies turns text",
    "op9_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10_language": "doc_id held_out lang_pred score",
    "op11_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op12_whitening": "vec_id component n deviation whitened explained identity_error",
    "op13_warc": "page_id payload_bytes payload_digest record_type refers_to",
}


def test_names_and_contract():
    import __spark_entry__ as contract

    assert set(QUERIES) == set(COLUMNS) and set(CHECKS) <= set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(CHECKS) <= set(contract.oracle_sql()) and "pipeline" not in contract.oracle_sql()


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs_on_whole_tables(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    assert frame.columns == COLUMNS[name].split()
    rows = frame.collect()
    if "doc_id" not in frame.columns:
        assert rows
        return
    ids = Counter(row["doc_id"] for row in rows if row.asDict().get("piece", 0) == 0)
    assert ids == Counter(r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, name):
    outcome = compare(spark, database(FOLDER), FOLDER, name, QUERIES[name], CHECKS[name])
    assert outcome.endswith(" ok"), outcome


def load_pipeline():
    path = Path(__file__).resolve().parents[2] / "corpus_pipeline.py"
    spec = importlib.util.spec_from_file_location("corpus_pipeline", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def stage_folders(spark):
    from urllib.parse import urlparse

    from factloom.session import ensure_checkpoint_dir

    return Path(urlparse(ensure_checkpoint_dir(spark)).path).glob("stage-*")


def five_words(text):
    words = text.encode().lower().split()
    wide = min(5, len(words))
    return {tuple(words[at : at + wide]) for at in range(len(words) - wide + 1) if wide}


def test_pipeline_by_brute_force(spark, odd_documents, odd_labels, tmp_path):
    """Scores come from the operators; rejects, groups, pieces and packing are done by hand."""
    pipeline = load_pipeline()
    assert [name for name, _ in pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    documents = odd_documents.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    odd_labels.write.parquet(str(tmp_path / "labels.parquet"))
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    for operator, good in ((quality, 1), (toxicity, 0)):
        keep = {r["doc_id"] for r in operator.predictions(left, labels).collect() if r["predicted"] == good}
        left = left.filter(left["doc_id"].isin(sorted(keep)))
    texts = {r["doc_id"]: r["text"] or "" for r in left.collect()}
    sets = {doc_id: five_words(text) for doc_id, text in texts.items()}
    first = {doc_id: doc_id for doc_id in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    first[a] = first[b] = min(first[a], first[b])
    kept = {doc_id for doc_id in texts if first[doc_id] == doc_id}
    assert 0 < len(kept) < len(texts)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter()
    for doc_id in kept:
        length = len(library.encode(texts[doc_id], add_special_tokens=False).ids) + 1
        wanted.update((doc_id, start, size) for start, size in packing.cut(length, 1024))
    before = set(stage_folders(spark))
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert set(stage_folders(spark)) == before
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in rows) == wanted
    loads = Counter()
    for row in rows:
        loads[row["sequence_id"]] += row["length"]
    assert max(loads.values()) <= 1024
    counts = np.bincount([size for _, _, size in wanted.elements()], minlength=1025)
    assert len(loads) == packing.plan(counts, 1024).sequences


def test_stages_keep_columns_and_pass_empty_tables(spark, odd_documents, odd_labels, tmp_path):
    pipeline = load_pipeline()
    odd_labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in pipeline.STAGES:
        for frame in (odd_documents, odd_documents.limit(0)):
            out = stage(spark, frame, str(tmp_path))
            assert name == "packing" or out.columns == odd_documents.columns
            assert out.count() == 0 or frame is odd_documents
