"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvengine.session import new_path

#: Rows of one Arrow batch where rows hold whole texts: a Python worker keeps one batch at a time.
TEXT_BATCH_ROWS = 500


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df`` written once to the shared folder and read back; zstd, since it may hold texts.

    Later passes read these files, so a lost executor costs a re-read, not a recomputation.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str = "__row") -> DataFrame:
    """A staged copy with a distinct long per row that every later read sees alike; ``name`` must be new."""
    if name in df.columns:
        raise ValueError(f"there is a column {name}")
    return stage(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def small_text_batches(spark: SparkSession) -> None:
    """Limits Arrow batches, so that a batch of long texts fits in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def held_out(id_column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id, as text, leaves ``fold`` when divided by ``folds``; NULL ids are held out."""
    remainder = F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(remainder == fold, F.lit(True))


def labelled_sample(labels: DataFrame, target: str, folds: int, fold: int, rows_per_class: int) -> DataFrame:
    """At most ``rows_per_class`` ids of each label outside the held-out fold, lowest id hash first.

    The result has the columns ``doc_id`` and ``y`` and is bounded by the parameter, so it may be broadcast.
    An id that is labelled twice, with different labels, is left out.
    """
    known = (
        labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
        .groupBy("doc_id")
        .agg(F.min(target).cast("int").alias("y"), F.max(target).cast("int").alias("other"))
        .where("y = other")
        .select("doc_id", "y")
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("y") == value).orderBy(*order).limit(rows_per_class) for value in (0, 1)]
    return parts[0].unionAll(parts[1])


def labelled_texts(documents: DataFrame, labels: DataFrame, target: str, folds: int, fold: int, rows_per_class: int) -> DataFrame:
    """(doc_id, y, text): one text for each id of ``labelled_sample``; of several rows of an id that of least text hash."""
    sample = F.broadcast(labelled_sample(labels, target, folds, fold, rows_per_class))
    texts = documents.select("doc_id", "text").join(sample, "doc_id")
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    return texts.groupBy("doc_id", "y").agg(least).select("doc_id", "y", "least.text")


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list], list[pa.Array]]], fields: str) -> DataFrame:
    """Adds the columns ``fields`` that the function from ``make()`` computes for lists of texts; drops ``text``.

    Runs as an Arrow map: other columns pass through untouched, so NULL ids and large ids stay exact. ``make`` is
    called once per task, for tables that a task keeps.
    """
    small_text_batches(df.sparkSession)
    passed = [f for f in df.schema.fields if f.name != text]
    added = T.StructType.fromDDL(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                made = work(batch.column(text).to_pylist())
                columns = [batch.column(name) for name in names] + made
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *new_names])

    names, new_names = [f.name for f in passed], added.fieldNames()
    return df.select(*names, text).mapInArrow(run, T.StructType([*passed, *added.fields]))
