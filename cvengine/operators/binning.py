"""Right-closed bins at quantile or equal-width edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvengine.operators.order import CELL_ROWS, not_after, quantiles, rows_at


def bin_by(value: Column, upper_edges: Sequence[float], labels: Sequence) -> Column:
    """The label of the first upper edge that is not below ``value``; above all edges the last."""
    chain = F.when(value <= F.lit(upper_edges[0]), F.lit(labels[0]))
    for edge, label in list(zip(upper_edges, labels))[1:-1]:
        chain = chain.when(value <= F.lit(edge), F.lit(label))
    return chain.when(value.isNotNull(), F.lit(labels[-1]))


def quantile_edges(
    df: DataFrame, value: str, bins: int, rows: int | None = None, cell_rows: int = CELL_ROWS
) -> list[float | None]:
    """``bins + 1`` edges from minimum to maximum."""
    return quantiles(df, value, [(k, bins) for k in range(bins + 1)], rows, cell_rows)


def edges_repeat(edges: Sequence[float | None]) -> bool:
    return len(set(edges)) < len(edges)


def equal_width(value: Column, low: float, high: float, labels: Sequence) -> Column:
    """Equal-width bins; a constant column falls into the middle bin."""
    bins = len(labels)
    if low == high:
        return F.when(value.isNotNull(), F.lit(labels[bins // 2]))
    step = (high - low) / bins
    return bin_by(value, [low + step * i for i in range(1, bins + 1)], labels)


def quantile_score(value: Column, edges: Sequence[float], labels: Sequence) -> Column:
    """Quantile bins, or equal-width bins where quantile edges repeat."""
    if edges[0] is None:
        return F.lit(None).cast("int")
    if edges_repeat(edges):
        return equal_width(value, edges[0], edges[-1], labels)
    return bin_by(value, edges[1:], labels)


def rank_score(
    df: DataFrame, keys: Sequence[str], labels: Sequence, rows: int, cell_rows: int = CELL_ROWS
) -> Column:
    """Quantile bins of the row number in the order of ``keys``.

    Row numbers are 1..n, so bin k ends at row 1 + k (n - 1) / bins: it is enough to find
    the few rows at those positions and compare keys with theirs.
    """
    bins = len(labels)
    if rows < 2:
        return F.lit(labels[bins // 2])
    ends = [k * (rows - 1) // bins for k in range(1, bins)]
    bound = rows_at(df, keys, ends, rows, cell_rows)
    chain = F.when(not_after(keys, bound[ends[0]]), F.lit(labels[0]))
    for end, label in list(zip(ends, labels))[1:]:
        chain = chain.when(not_after(keys, bound[end]), F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))


def labelled_quantiles(
    value: Column, edges: Sequence[float], labels: Sequence[str], on_ties: str = "raise"
) -> Column:
    """Named quantile bins. Repeated edges raise, or with ``merge`` empty the upper bins."""
    if on_ties not in ("raise", "merge"):
        raise ValueError("on_ties must be 'raise' or 'merge'")
    if edges_repeat(edges) and on_ties == "raise":
        raise ValueError(f"Bin edges must be unique: {list(edges)}")
    return bin_by(value, edges[1:], labels)
