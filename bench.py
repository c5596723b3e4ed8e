"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of tables   (default /root/testdata/sf0.1)
BENCH_CPUS    local cores        (default 8)
BENCH_RUNS    timed runs per query, the median counts; one more run before warms up (default 1)

The given tables are single files, which one task reads whatever the number of
cores.  Inputs are therefore staged first as tables of several files each; that
time is reported as ``staging_seconds`` and is not part of the queries.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from pathlib import Path

from factloom.plans.catalog import QUERIES
from factloom.plans.inputs import Inputs, StagedInputs
from factloom.session import build_session

HEADLINE = [
    "normalize_text", "clean_flags", "lang_profile", "split_sentences", "translate_segments",
    "ocr_reading_order", "ocr_documents", "segment_aggregate", "claim_extract", "domain_lexicon",
    "domain_validate", "evidence_load", "evidence_metrics", "reflection_safeguards", "attempt_stop",
    "verdict_parse", "key_evidence", "explain_validate", "verification_report", "reflection_prompts",
]
STAGED = [
    "noisy_documents", "submissions", "images", "ocr_blocks", "translation_memory", "claims",
    "evidence", "replies", "reflection_replies", "verdict_replies", "explanation_replies",
    "domain_replies",
]


def timed(inputs: Inputs, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name].build(inputs).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory(prefix="factloom-bench-") as staging:
        started = time.perf_counter()
        inputs = StagedInputs(spark, folder, staging, 2 * int(cpus))
        for name in STAGED:
            getattr(inputs, name)
        staged = time.perf_counter() - started
        seconds = {}
        for name in HEADLINE:
            timed(inputs, name)
            seconds[name] = round(statistics.median(timed(inputs, name) for _ in range(runs)), 3)
        print(
            json.dumps(
                {
                    "metric": "headline_total_seconds",
                    "value": round(sum(seconds.values()), 3),
                    "unit": "sec",
                    "queries": seconds,
                    "sf": Path(folder).name.removeprefix("sf"),
                    "staging_seconds": round(staged, 3),
                }
            )
        )
        spark.stop()


if __name__ == "__main__":
    main()
