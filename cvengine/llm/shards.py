"""Blocks of documents with a vocabulary of their own, and shards of keys where what the blocks know of a key is added up.

A block is a row: its token sequence and its vocabulary as arrays. A key, the 64-bit hash of a word or a pair of ids, belongs to
the shard that its leading bits name. A block sends each shard one row with all it has for it, and gets one row back. So a key
reaches a shard once per block however often it occurs, and no shard or block depends on the size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries (a key of a block) that a shard holds on average.
SHARD_ENTRIES = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(dict):
    """Local numbers of tokens, in order of first appearance."""

    def __missing__(self, token: bytes) -> int:
        value = self[token] = len(self)
        return value


class BlockNumbers:
    """Numbers for the blocks a task makes, different from those of all other tasks."""

    def __init__(self) -> None:
        self.next = TaskContext.get().partitionId() << 33

    def take(self) -> int:
        self.next += 1
        return self.next


def planes(values: np.ndarray) -> bytes:
    """Integers as bytes, all lowest bytes first, then all second ones: leading zeros lie together and compress well."""
    return values.view(np.uint8).reshape(values.size, values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def mixed(keys: np.ndarray) -> np.ndarray:
    """Keys made of counters, spread over 64 bits; a bijection."""
    keys = keys.astype(np.uint64)
    keys = (keys ^ (keys >> np.uint64(32))) * _MIX
    return keys ^ (keys >> np.uint64(29))


def shard_edges(sorted_keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's stretch of ascending unsigned keys begins, and the end."""
    first = [(s << 64) // shards + (1 if (s << 64) % shards else 0) for s in range(1, shards)]
    return np.r_[0, np.searchsorted(sorted_keys, np.array(first, np.uint64)), sorted_keys.size]


def shard_count(entries: int | None) -> int:
    return max(1, -(-int(entries or 0) // SHARD_ENTRIES))


def binary_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def summed(rows: DataFrame, column: str) -> np.ndarray:
    """Sum, place by place, of an array column over all rows that have one; the arrays have the same fixed length."""
    found = rows.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    return np.array([r["x"] for r in sorted(found.collect())], dtype=np.float64)
