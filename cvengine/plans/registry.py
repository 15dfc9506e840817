"""The table of registered queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the statement its result is compared with."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            CHECK_SQL[name] = sql
        return function

    return add


def six_digits(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison; ``special`` names columns with other digits."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(F.col(c), special.get(c, digits)) for c in doubles})


def day(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as text to the second."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})
