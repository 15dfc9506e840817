"""The action log as a stream: daily counts and intake of new records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cvengine.session import new_path
from cvengine.sources.published import finished
from cvengine.sources.schemas import ACTION


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet event files as an action stream. Event time must be TIMESTAMP for a watermark."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path).select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("action")
    )


def daily_counts(actions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Actions per day and type. On a stream a day is emitted once the watermark passes its end."""
    if actions.isStreaming:
        actions = actions.withWatermark("timestamp", delay)
    counted = actions.groupBy(F.window("timestamp", "1 day").alias("day"), "action")
    return counted.agg(F.count(F.lit(1)).alias("count")).select(F.col("day.start").alias("day"), "action", "count")


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Process what is there, append it to Parquet and return the sink as a batch frame.

    The checkpoint makes a restart continue where the last run stopped.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(sink)


def count_available(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    counts = daily_counts(event_stream(spark, path), delay)
    return run_available(counts, new_path(spark, "daily-counts"), new_path(spark, "daily-counts-progress"))


def _records(spark: SparkSession, path: str, files_per_batch: int = 1000) -> tuple[DataFrame, Column]:
    """New JSON-line records as a stream, and whether one has a time, an action and an id."""
    schema = StructType([*ACTION.fields, StructField("raw", StringType())])
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    records = reader.json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="raw")
    return records, F.col("timestamp").isNotNull() & F.col("action").isNotNull() & F.col("id").isNotNull()


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """What ``intake`` leaves out as malformed: the records as far as they could be read, or their raw text."""
    records, sound = _records(spark, path)
    return records.where(~sound)


def intake(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    """New JSON-line records without repeats of an id; ``rejects`` streams the malformed ones to a table of their own.

    ``delay`` is how much older than the newest record one may be: later ones cannot be told from repeats and are
    dropped, which Spark counts in numRowsDroppedByWatermark of the query's progress.
    """
    records, sound = _records(spark, path)
    return records.where(sound).drop("raw").withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["id"])


KINDS = ("taken", "repeated", "late", "malformed")


def _classified(batch: DataFrame, sound: Column, earlier: DataFrame | None, delay: str) -> DataFrame:
    """``batch`` with its ``kind``; ``earlier`` holds the sound records of all batches before it."""
    spark = batch.sparkSession
    horizon = None
    if earlier is not None:
        horizon = earlier.agg(F.max("timestamp") - F.expr(f"interval {delay}")).first()[0]
    late = F.lit(False) if horizon is None else F.col("timestamp") < F.lit(horizon)
    early = F.when(~F.coalesce(sound, F.lit(False)), "malformed").when(late, "late")
    marked = batch.withColumns({"kind": early, "__order": F.monotonically_increasing_id()})
    if earlier is None:
        known = spark.createDataFrame([], "known string")
    else:
        recent = earlier.where(F.col("kind") == "taken")
        recent = recent if horizon is None else recent.where(F.col("timestamp") >= F.lit(horizon))
        known = recent.select(F.col("id").alias("known"))
    # of equal ids in the batch the earliest is taken; a count by id is pre-aggregated, so a frequent id is no hot key
    first = marked.where("kind is null").groupBy("id").agg(F.min(F.struct("timestamp", "__order")).alias("first"))
    first = first.join(known, first["id"] == known["known"], "left_anti").select(F.col("first.__order").alias("__taken"))
    placed = marked.join(first, marked["__order"] == first["__taken"], "left")
    kind = F.coalesce("kind", F.when(F.col("__taken").isNotNull(), "taken").otherwise("repeated"))
    return placed.withColumn("kind", kind).drop("__order", "__taken")


def split_intake(spark: SparkSession, path: str, sink: str, checkpoint: str, delay: str = "1 day", files_per_batch: int = 1000) -> DataFrame:
    """Take in all new JSON-line records and return the sink: every record once, with its ``batch`` and ``kind``.

    * ``taken``: the first record of an id;
    * ``repeated``: another one, in the same batch or within ``delay`` of the newest record before it;
    * ``late``: more than ``delay`` older than the newest record of the batches before;
    * ``malformed``: without time, action or id, or not JSON; ``raw`` holds its text.

    A batch is written as a whole to a folder that its number names, so a batch that is run again after a failure replaces
    what it had written, and a classification reads finished batches of smaller numbers only. Ids are compared with those of
    records within ``delay``; older ones cannot be met again, as such a repeat is late.
    """
    records, sound = _records(spark, path, files_per_batch)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        done = [f"{sink}/{n}" for n in finished(session, sink) if int(n.split("=")[1]) < number]
        earlier = session.read.option("basePath", sink).schema(schema).parquet(*done).where("kind <> 'malformed'") if done else None
        batch = batch.persist()
        try:
            _classified(batch, sound, earlier, delay).write.mode("overwrite").partitionBy("kind").parquet(f"{sink}/batch={number:09d}")
        finally:
            batch.unpersist()

    schema = StructType([*records.schema.fields, StructField("batch", LongType()), StructField("kind", StringType())])
    query = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = [f"{sink}/{n}" for n in finished(spark, sink)]
    return spark.read.option("basePath", sink).schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
