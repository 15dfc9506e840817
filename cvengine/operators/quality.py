"""Validation rules and the data-quality score, each a fixed number of passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvengine import fixed_values as fixed
from cvengine.operators.order import CELL_ROWS, column_quantiles

NON_NEGATIVE = fixed.VALIDATED_COLUMNS[1:6]
RESULT = "rule string, level string, violations bigint"


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in fixed.VALIDATED_COLUMNS if c not in df.columns]


def duplicate_ids(df: DataFrame, column: str = "customer_id") -> DataFrame:
    """Ids that occur more than once, with their number of rows."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def validate(df: DataFrame) -> DataFrame:
    """One row per rule with its number of violations. Missing columns stop the other rules."""
    absent = missing_columns(df)
    if absent:
        rows = [(f"missing column {c}", "error", 1) for c in absent]
        return df.sparkSession.createDataFrame(rows, RESULT)
    rules = {f"negative {c}": ("error", F.col(c) < 0) for c in NON_NEGATIVE}
    rules["last purchase before first"] = (
        "error",
        F.col("days_since_last_purchase") > F.col("days_since_first_purchase"),
    )
    rules["unrealistic age"] = ("warning", (F.col("age") < 13) | (F.col("age") > 120))
    counts = df.agg(*[F.count_if(broken).alias(name) for name, (_, broken) in rules.items()])
    repeats = duplicate_ids(df).agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate customer id")
    )
    levels = {name: level for name, (level, _) in rules.items()} | {"duplicate customer id": "error"}
    wide = counts.crossJoin(F.broadcast(repeats))
    level = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
    long = wide.unpivot([], list(levels), "rule", "violations")
    return long.select("rule", level[F.col("rule")].alias("level"), "violations")


def messages(report: DataFrame) -> dict[str, list[str]]:
    """Broken rules as ``errors`` and ``warnings``; the report has a handful of rows."""
    broken = report.where(F.col("violations") > 0).orderBy("rule").collect()
    return {
        "errors": [r["rule"] for r in broken if r["level"] == "error"],
        "warnings": [r["rule"] for r in broken if r["level"] == "warning"],
    }


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def outlier_bounds(df: DataFrame, columns: list[str], cell_rows: int = CELL_ROWS) -> dict[str, tuple[float, float]]:
    """Per column with values the fences 1.5 quartile ranges outside the quartiles, all columns in the same passes."""
    quartiles = column_quantiles(df, columns, [(1, 4), (3, 4)], cell_rows)
    return {c: (q1 - (q3 - q1) * 1.5, q3 + (q3 - q1) * 1.5) for c, (q1, q3) in quartiles.items() if q1 is not None}


def _outlying(df: DataFrame, cell_rows: int) -> Column:
    """Aggregate: mean over numeric columns of the percentage of rows outside the fences."""
    columns = numeric_columns(df)
    if not columns:
        return F.lit(0.0)
    fences = outlier_bounds(df, columns, cell_rows)
    outside = [
        F.count_if((F.col(c) < F.lit(fences[c][0])) | (F.col(c) > F.lit(fences[c][1]))) for c in columns if c in fences
    ]
    shares = sum((F.try_divide(o, F.count(F.lit(1))) for o in outside), F.lit(0.0))
    return shares / len(columns) * 100


def _complete(df: DataFrame) -> Column:
    """Aggregate: percentage of cells that are not NULL."""
    cells = F.count(F.lit(1)) * len(df.columns)
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return F.try_divide(cells - missing, cells) * 100


def outlier_rate(df: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    return df.agg(_outlying(df, cell_rows).alias("outlier_rate"))


def completeness(df: DataFrame) -> DataFrame:
    return df.agg(_complete(df).alias("completeness"))


def _canonical(value: Column, kind: T.DataType) -> Column:
    """``value`` so that equal values have one form: one NaN, no -0.0, entries of maps in the order of their keys.

    Times become text, since JSON would cut them at milliseconds.
    """
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(value), F.lit(float("nan"))).otherwise(value + F.lit(0.0).cast(kind))
    if isinstance(kind, T.MapType):
        pair = lambda e: F.struct(_canonical(e["key"], kind.keyType).alias("k"), _canonical(e["value"], kind.valueType).alias("v"))
        return F.array_sort(F.transform(F.map_entries(value), pair))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _canonical(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_canonical(value.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind)])
        return F.when(value.isNotNull(), fields)
    if isinstance(kind, (T.DatetimeType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return value.cast("string")
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    return value


def row_digest(df: DataFrame) -> Column:
    """16 bytes that are equal for equal rows, whatever the columns' types: a digest of the row's canonical JSON."""
    if not df.columns:
        return F.lit(b"")
    cells = [_canonical(F.col(f"`{f.name}`"), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema)]
    return F.unhex(F.md5(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})))


def duplicate_rate(df: DataFrame) -> DataFrame:
    """Percentage of rows that repeat an earlier identical row; maps and variants are compared by content.

    Only a digest of each row is shuffled.
    """
    groups = df.select(row_digest(df).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("rows"))
    rows = F.sum("rows")
    return groups.agg((F.try_divide(rows - F.count(F.lit(1)), rows) * 100).alias("duplicate_rate"))


def quality_score(df: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row: completeness, duplicate rate, outlier rate and the weighted score (at most 60).

    Completeness and outliers share a pass, after the one that finds the fences.
    """
    counted = df.agg(_complete(df).alias("completeness"), _outlying(df, cell_rows).alias("outlier_rate"))
    parts = counted.crossJoin(F.broadcast(duplicate_rate(df)))
    parts = parts.select("completeness", "duplicate_rate", "outlier_rate")
    return parts.withColumn(
        "overall_score",
        F.col("completeness") * 0.6 - F.col("duplicate_rate") * 0.2 - F.col("outlier_rate") * 0.2,
    )
