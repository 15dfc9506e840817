"""A JSON log on disk that keeps its newest entries only: appends are segments, compaction publishes a new base."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvengine import fixed_values as fixed
from cvengine.operators.logs import most_recent
from cvengine.sources.published import announce, finished, latest, remove


class RetainedLog:
    """Entries of ``schema`` (with ``id`` and ``timestamp``) under ``path``, of which the newest ``keep`` are the log.

    Every append writes a segment of its own. ``compact`` writes the newest entries of the base and all finished
    segments as a new base and announces it, with the segments it holds, last. Readers take the announced base and
    the finished segments that are not in it. So an append or compaction that is killed changes nothing that is read, an append
    during a compaction stays a segment, and of two compactions at once one fails. Files that no reader needs are
    deleted by ``clean``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keep: int = fixed.LOG_KEEP) -> None:
        self.spark, self.schema, self.keep = spark, schema, keep
        path = path.rstrip("/")
        self.segments, self.bases, self.announced = f"{path}/segments", f"{path}/bases", f"{path}/announced"

    def append(self, records: DataFrame) -> None:
        """Add records as they are; those without an id or a time get one."""
        stamps = {"id": F.uuid(), "timestamp": F.current_timestamp()}
        for name, made in stamps.items():
            records = records.withColumn(name, F.coalesce(F.col(name), made) if name in records.columns else made)
        names = [f.name for f in self.schema if f.name in records.columns]
        records.select(*names).write.json(f"{self.segments}/{uuid.uuid4().hex}")

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).json(paths)

    def _state(self) -> tuple[int, dict, list[str]]:
        number, state = latest(self.spark, self.announced)
        held = set(state.get("segments", []))
        return number, state, [s for s in finished(self.spark, self.segments) if s not in held]

    def _stored(self, state: dict, fresh: list[str]) -> DataFrame:
        base = [f"{self.bases}/{state['base']}"] if state else []
        return self._read([*base, *(f"{self.segments}/{s}" for s in fresh)])

    def read(self) -> DataFrame:
        """The newest ``keep`` entries, newest first; each task keeps its own before they are merged."""
        _, state, fresh = self._state()
        return most_recent(self._stored(state, fresh), self.keep)

    def compact(self) -> None:
        """Make the newest ``keep`` entries the new base."""
        number, state, fresh = self._state()
        base = uuid.uuid4().hex
        most_recent(self._stored(state, fresh), self.keep).write.json(f"{self.bases}/{base}")
        present = set(finished(self.spark, self.segments))
        held = [s for s in state.get("segments", []) if s in present]
        there = set(finished(self.spark, self.bases))
        old = [b for b in [*state.get("old", []), state.get("base")] if b in there]
        announce(self.spark, self.announced, number + 1, {"base": base, "old": old, "segments": [*held, *fresh]})

    def clean(self) -> None:
        """Delete segments and bases that the announced state replaces; run it when no reader uses an older one."""
        _, state, _ = self._state()
        if not state:
            return
        for segment in state["segments"]:
            remove(self.spark, f"{self.segments}/{segment}")
        for base in state["old"]:
            remove(self.spark, f"{self.bases}/{base}")

    def stored_rows(self) -> int:
        """Rows in the files that readers take."""
        _, state, fresh = self._state()
        return self._stored(state, fresh).count()
