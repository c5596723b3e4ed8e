"""What the operators of this folder share: tables, pinning, skew-safe joins, numbering."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A key with more than this share of all rows (1 in so many) is joined by broadcast.
#: As the shares add up to one, there are at most so many such keys.
HOT_SHARE = 1000
#: Rows that a numbering bucket holds on average.
BUCKET_ROWS = 50_000

_PACKAGE = Path(__file__).resolve().parents[1]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_code(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, unless their path has it already."""
    root = str(_PACKAGE.parent)
    context = spark.sparkContext
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if root not in known and not getattr(context, "_factloom_sent", False):
        archive = Path(tempfile.mkdtemp(prefix="factloom-code-")) / f"{_PACKAGE.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(_PACKAGE.rglob("*.py")):
                out.write(file, file.relative_to(_PACKAGE.parent))
        context.addPyFile(str(archive))
        context._factloom_sent = True
    return spark


def pinned(frame: DataFrame) -> DataFrame:
    """Compute once, into the shared checkpoint folder, so that later reads see the same rows.

    Only narrow tables are pinned: keys and numbers, never texts.
    """
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> tuple[DataFrame, str]:
    """Write as Parquet into a new folder of the shared checkpoint folder, and read again.

    The folder is the caller's to remove, see :func:`removed`.
    """
    spark = frame.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return spark.read.parquet(folder), folder


def removed(spark: SparkSession, folder: str) -> None:
    """Remove a folder that :func:`stored` made."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    """The text with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unused(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(name: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % divisor


def attach(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Inner join on ``key``, which is unique in ``right`` and never null.

    ``rows`` names the column of ``right`` that counts the rows of ``left`` with the
    key; ``total`` is their sum.  The few keys with more than a thousandth of all rows
    (at most :data:`HOT_SHARE` of them) are broadcast, so no task gets a hot key.
    """
    hot = F.col(rows) > max(1, total // HOT_SHARE)
    few = F.broadcast(right.filter(hot))
    return left.join(few, key).unionByName(
        left.join(F.broadcast(right.filter(hot).select(key)), key, "left_anti").join(
            right.filter(~hot), key
        )
    )


def numbered(
    frame: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, total: int
) -> DataFrame:
    """Number the rows of each key from 0 without gaps, with no task per key.

    Rows of a key are dealt to buckets by a hash of ``order``; each bucket is numbered
    by itself and starts where the buckets before it end.  ``frame`` must give the same
    rows each time it is read.
    """
    buckets = max(8, -(-total // BUCKET_ROWS))
    dealt = frame.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_here"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sizes.select(
        *keys, "_bucket", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        dealt.withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts, [*keys, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_at")).cast("long"))
        .drop("_bucket", "_start", "_at")
    )


def sample_labels(
    labels: DataFrame, value: str, divisor: int, held_out: int, bound: int
) -> DataFrame:
    """(doc_id, label, weight) of about ``bound`` rows per class that may be learned from.

    Rows are chosen by a hash of the id, so the choice repeats; ``weight`` is the inverse
    of the share that was chosen.  Rows of one id count once, with their largest label;
    null ids and labels are left out.
    """
    usable = (
        labels.select("doc_id", F.col(value).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .filter(remainder("doc_id", divisor) != held_out)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    sizes = usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    share = F.lit(1.0)
    for row in sizes:
        share = F.when(F.col("label") == row["label"], min(1.0, bound / row["n"])).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(value), "doc_id"), F.lit(1_000_000)) / 1_000_000
    return usable.withColumn("weight", 1 / share).filter(draw * F.col("weight") < 1)
