"""The report sink: a plain partitioned write, and a store that batches are upserted into.

A store keeps each batch in a folder of its own, with the tables ``report``, ``citations`` and
``rejects``.  A batch counts once its manifest is there, a small file that appears by a rename
after all tables are written; readers take the list of manifests once, so they see a batch
whole or not at all.  Of a claim that several batches hold, the last batch counts in all three
tables: a changed verdict moves the claim, and one that is rejected now leaves the report.

Writing costs only the batch.  Reading finds the last batch of each claim with one narrow
aggregate; :func:`compact` writes the current rows as one batch that replaces those before it.
One writer at a time: a second one that commits the same number fails.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import names, read_text, write_once

TABLES = ("report", "citations", "rejects")
#: Folder of a report's verdict, as in :func:`write_report`.
VERDICT = "final_verdict"


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the verification report, one folder per final verdict.

    There are three verdicts only, so files are not repartitioned by them: each
    task writes its share of every verdict, and no verdict has to fit in a task.
    """
    report.write.mode(mode).partitionBy(VERDICT).parquet(path)


def _entries(spark: SparkSession, path: str) -> list[dict]:
    """All manifests in the order of their commits."""
    found = [name for name in names(spark, f"{path}/manifest") if name.endswith(".json")]
    return [json.loads(read_text(spark, f"{path}/manifest/{name}")) for name in found]


def _counting(entries: list[dict]) -> list[dict]:
    """Those that a later one has not replaced."""
    kept: list[dict] = []
    for entry in entries:
        kept = [e for e in kept if e["batch"] not in entry["replaces"]] + [entry]
    return kept


def manifest(spark: SparkSession, path: str) -> list[str]:
    """The batches that count, in the order of their commits."""
    return [entry["batch"] for entry in _counting(_entries(spark, path))]


def _commit(
    report: DataFrame, citations: DataFrame, rejects: DataFrame, path: str, batch: str, replaces: list[str]
) -> None:
    spark = report.sparkSession
    number = len(_entries(spark, path))
    folder = f"{path}/batches/{batch}"
    # What a failed try has left is overwritten.
    write_report(report, f"{folder}/report", "overwrite")
    citations.write.mode("overwrite").parquet(f"{folder}/citations")
    rejects.write.mode("overwrite").parquet(f"{folder}/rejects")
    # A table without rows leaves no file to read its columns from.
    schemas = {name: frame.schema.jsonValue() for name, frame in zip(TABLES, (report, citations, rejects))}
    entry = json.dumps({"batch": batch, "replaces": replaces, "schemas": schemas})
    write_once(spark, f"{path}/manifest/{number:09d}.json", entry)


def upsert_report(
    report: DataFrame, citations: DataFrame, rejects: DataFrame, path: str, batch: str
) -> bool:
    """Add a batch; False, with nothing written, if a batch of this name is there already.

    The tables have ``claim_id``; ``report`` has one row per claim.
    """
    if any(entry["batch"] == batch for entry in _entries(report.sparkSession, path)):
        return False
    _commit(report, citations, rejects, path, batch, [])
    return True


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The current rows of the three tables, each with the ``batch`` they came in."""
    entries = _counting(_entries(spark, path))
    if not entries:
        raise FileNotFoundError(f"no batch in {path}")

    def of(table: str) -> DataFrame:
        parts = [
            spark.read.schema(StructType.fromJson(entry["schemas"][table]))
            .parquet(f"{path}/batches/{entry['batch']}/{table}")
            .withColumns({"batch": F.lit(entry["batch"]), "_number": F.lit(number)})
            for number, entry in enumerate(entries)
        ]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    tables = {table: of(table) for table in TABLES}
    # Citations belong to claims of the report, so two tables say where a claim was last.
    seen = [tables[name].select("claim_id", "_number") for name in ("report", "rejects")]
    last = seen[0].unionByName(seen[1]).groupBy("claim_id").agg(F.max("_number").alias("_number"))
    return {
        table: frame.join(last, ["claim_id", "_number"], "left_semi").drop("_number")
        for table, frame in tables.items()
    }


def compact(spark: SparkSession, path: str, batch: str) -> None:
    """Write the current rows as one batch that replaces all before it.

    Replaced folders stay for readers that began earlier.
    """
    if any(entry["batch"] == batch for entry in _entries(spark, path)):
        return
    current = {name: frame.drop("batch") for name, frame in read_report(spark, path).items()}
    _commit(*(current[name] for name in TABLES), path, batch, manifest(spark, path))
