"""Numbered announcements in a folder: what was written before one is whole, what was written after none is invisible."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _entries(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """(name, whether a writer has finished it) for each folder inside ``folder``; none if it does not exist."""
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = new(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path) if s.isDirectory()]
    return [(p.getName(), bool(files.exists(new(p, "_SUCCESS")))) for p in found]


def finished(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in ``folder`` that Spark has written to the end."""
    return sorted(name for name, done in _entries(spark, folder) if done)


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def latest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the last announcement, (0, {}) without one; unfinished ones do not count."""
    numbers = [int(name) for name in finished(spark, folder) if name.isdigit()]
    if not numbers:
        return 0, {}
    return max(numbers), json.loads(spark.read.text(f"{folder}/{max(numbers):012d}", wholetext=True).first()[0])


def announce(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Publish ``content`` under ``number``; fails if that number is taken, so of two writers one wins.

    A number left unfinished by a killed writer is taken by the next one.
    """
    name = f"{number:012d}"
    if (name, False) in _entries(spark, folder):
        remove(spark, f"{folder}/{name}")
    spark.createDataFrame([(json.dumps(content),)], "content string").coalesce(1).write.text(f"{folder}/{name}")


def digests(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each file under ``path``, by its place there. Only digests reach the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found: DataFrame = files.select("path", F.sha2("content", 256).alias("digest"))
    root = path.rstrip("/").split("://")[-1].removeprefix("file:").lstrip("/")
    return {r["path"].split(root, 1)[-1].lstrip("/"): r["digest"] for r in found.collect()}
