"""Batch readers. CSV cells are read as text; cleaning casts them, bad cells become NULL."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvengine.functions.scalars import finite

SPREADSHEETS = (".xlsx", ".xls")


def read_table(spark: SparkSession, source: str | DataFrame, multi_line: bool = False) -> DataFrame:
    """A DataFrame as it is, or a path read by its suffix.

    An empty CSV cell is missing (NULL), quoted or not. A spreadsheet path is read from the CSV of the same name beside it. ``multi_line`` takes quoted line breaks in
    CSV cells; each file is then read by one task, so large files should be several.
    """
    if isinstance(source, DataFrame):
        return without_non_finite(source)
    path = source
    for suffix in SPREADSHEETS:
        if path.lower().endswith(suffix):
            path = path[: -len(suffix)] + ".csv"
    lowered = path.rstrip("/").lower()
    if lowered.endswith((".parquet", ".pq")):
        return without_non_finite(spark.read.parquet(path))
    if lowered.endswith((".json", ".jsonl", ".ndjson")):
        return without_non_finite(spark.read.json(path))
    return spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, multiLine=multi_line, escape='"')


def without_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating-point columns become NULL at the edge."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.withColumns({name: finite(F.col(f"`{name}`")) for name in floating})


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON log: a folder of JSON lines or a file that holds one array. A missing path is empty."""
    try:
        multi_line = path.lower().endswith(".json")
        return spark.read.schema(schema).option("multiLine", multi_line).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
