"""Column expressions shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,12)"


def finite(col: Column) -> Column:
    """Double with NaN and infinities as NULL, and -0.0 as 0.0."""
    value = col.cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value + F.lit(0.0))


def money_sum(col: Column) -> Column:
    """Sum in decimals of twelve places, the same total for every partition order.

    Where a value or the total is too large for that, the sum of the doubles.
    """
    exact = col.try_cast(MONEY)
    total = F.when(F.count(exact) == F.count(col), F.try_sum(exact).cast("double"))
    return F.coalesce(total, F.sum(col.cast("double")))


def money_mean(col: Column) -> Column:
    return F.try_divide(money_sum(col), F.count(col))


def whole_days(earlier: Column, later: Column) -> Column:
    """Complete 24-hour days from ``earlier`` to ``later`` (23:00 to 01:00 is 0)."""
    return F.timestamp_diff("DAY", earlier, later)


def number(col: Column) -> Column:
    """Text to double; text that is no number becomes NULL."""
    return finite(col.try_cast("double"))


def timestamp(col: Column) -> Column:
    """Text to timestamp; text that is no date becomes NULL."""
    return col.try_cast("timestamp_ntz")


def half_even(col: Column, digits: int) -> Column:
    return F.bround(col, digits)


def currency(col: Column) -> Column:
    """``$1,234.50``; NULL is shown as N/A."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(col, 2)), F.lit("N/A"))


def percent(share: Column, digits: int = 2) -> Column:
    """A share as ``12.34%``; NULL is shown as N/A."""
    return F.coalesce(percent_points(share * 100, digits), F.lit("N/A"))


def percent_points(points: Column, digits: int = 1) -> Column:
    pattern = "0." + "0" * digits if digits else "0"
    return F.concat(F.call_function("format_number", points, F.lit(pattern)), F.lit("%"))


def title_words(col: Column) -> Column:
    """``win_back`` as ``Win Back``."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def clean_text(col: Column) -> Column:
    """Runs of whitespace become one blank, ends are trimmed, angle brackets are escaped."""
    blank = F.regexp_replace(col, r"(?U)[\s\x1c-\x1f]+", " ")
    escaped = F.replace(F.replace(blank, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.coalesce(F.trim(escaped), F.lit(""))
