"""Folders and small files on whatever file system a path names."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _located(spark, path)
    return system.exists(place)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder; none if it is not there."""
    system, place = _located(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not be there yet; it appears whole, by a rename."""
    if exists(spark, path):
        raise FileExistsError(path)
    system, draft = _located(spark, f"{path}.draft")
    out = system.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not system.rename(draft, _located(spark, path)[1]):
        raise FileExistsError(path)


def written(spark: SparkSession, folder: str) -> bool:
    """Whether a Spark job has finished writing the folder."""
    return exists(spark, f"{folder}/_SUCCESS")
