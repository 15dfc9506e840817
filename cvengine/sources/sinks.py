"""Batch writers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def export_csv(df: DataFrame, folder: str, name: str, at: datetime | None = None) -> str:
    """Write ``<folder>/<name>_<yyyymmdd_hhmmss>`` as CSV parts with a header; returns the path.

    Quotes in cells are doubled and white space at their ends is kept.
    """
    stamp = (at or datetime.now()).strftime("%Y%m%d_%H%M%S")
    path = f"{folder.rstrip('/')}/{name}_{stamp}"
    df.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def export_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def append_records(records: DataFrame, path: str, schema: T.StructType) -> None:
    """Append records to a JSON-lines log, giving each an id and the current time."""
    stamped = records.withColumns({"id": F.uuid(), "timestamp": F.current_timestamp()})
    present = [f.name for f in schema if f.name in stamped.columns]
    stamped.select(*present).write.mode("append").json(path)
