import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from factloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def apply(spark):
    """Evaluate a Column function over a list of texts, in order."""

    def run(function, texts):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame(list(enumerate(texts)), "at int, text string")
        rows = frame.select("at", function(F.col("text")).alias("out")).collect()
        return [row["out"] for row in sorted(rows, key=lambda row: row["at"])]

    return run
