"""Work units for comparing the rows of a bucket with each other, whatever the bucket's size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that make a task worth its while.
LEAST_ROWS = 1024
#: Columns that name a unit of work.
UNIT = ["__unit", "__left", "__right"]


def work_units(rows: DataFrame, bucket: list[str], row: str, size: str, block_rows: int, units: int) -> DataFrame:
    """Adds the columns UNIT and ``__own`` (which block a row is in) to rows that carry their bucket's size.

    Small buckets are dealt by hash to ``units`` units, each holding many of them. A bucket above
    ``block_rows`` is cut by a hash of ``row`` into blocks of about that size, and each pair of blocks is a
    unit of its own, so no task ever holds more than two blocks of a hot bucket and every pair of its
    rows still meets exactly once.
    """
    blocks = F.ceil(F.col(size) / F.lit(block_rows)).cast("int")
    own = F.when(F.col(size) > block_rows, F.pmod(F.xxhash64(F.lit(11), row), blocks).cast("int")).otherwise(F.lit(-1))
    hashed = F.xxhash64(*bucket)
    spread = (
        rows.withColumn("__own", own)
        .withColumn("__other", F.explode(F.when(F.col("__own") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), blocks - 1))))
        .withColumn("__left", F.least("__own", "__other"))
        .withColumn("__right", F.greatest("__own", "__other"))
    )
    unit = F.when(F.col("__own") < 0, F.pmod(hashed, F.lit(units))).otherwise(hashed)
    return spread.withColumn("__unit", unit).drop("__other")


def block_count(spark: SparkSession, rows: Column, most: int) -> Column:
    """Blocks of at most ``most`` rows on average; of fewer, down to LEAST_ROWS, where that keeps all shuffle partitions at work."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for_work = F.least(F.ceil(rows / F.lit(LEAST_ROWS)), F.lit(partitions))
    return F.greatest(F.ceil(rows / F.lit(most)), for_work, F.lit(1)).cast("int")


def pair_mask(own_left: int, own_right: int, own: np.ndarray, rows: slice, columns: slice) -> np.ndarray:
    """Which pairs (row, column) of a unit count: above the diagonal within a block, across blocks otherwise."""
    at, to = np.arange(own.size)[rows], np.arange(own.size)[columns]
    above = at[:, None] < to[None, :]
    if own_left == own_right:
        return above
    return above & (own[rows][:, None] != own[columns][None, :])


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The root of each of ``n`` items under the given links: the item of the smallest position reachable."""
    root = np.arange(n)
    while left.size:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return root
