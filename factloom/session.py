"""Session settings that the operators in this package expect."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Runtime settings the plans rely on.  Skew joins and runtime broadcast sizing
#: are left to adaptive execution, so it must stay on.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where a later step could have reused its partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The rule chains generate long methods.  HotSpot never compiles a method above
    # 8000 bytes of bytecode; below this limit Spark splits such stages instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    # Replies may repeat a key; the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with :data:`RUNTIME_CONF`; keyword settings win over it."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, reading the one the cluster names.

    A folder of our own is used only where none is configured and the session
    runs inside one machine; on a cluster a machine-local folder would be lost
    with its executor, so that case is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="factloom-checkpoint-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(named)
    return named
