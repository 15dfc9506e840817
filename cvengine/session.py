"""Session construction and the shared folder that holds intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_staged: dict[str, list[str]] = {}
_tables: dict[str, list[str]] = {}


def build_session(master: str | None = None, app_name: str = "cvengine", **conf: str) -> SparkSession:
    """A session with the settings the engine is tested under.

    On a cluster leave ``master`` to spark-submit and pass ``spark.checkpoint.dir`` there.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: ``spark.checkpoint.dir``.

    Only a local master may run without that setting; it then gets one temporary folder
    per application, which every thread of the single JVM can read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="cvengine-")
    return _local_folders[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, remembered for ``drop_staged``."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_staged(spark: SparkSession) -> None:
    """Delete the intermediate tables this application wrote. Frames built on them end with it."""
    jvm = spark.sparkContext._jvm
    for name in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for name in _staged.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(configuration).delete(path, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving the intermediate tables that were staged inside. Frames built on them end there."""
    application = spark.sparkContext.applicationId
    outer, outer_tables = _staged.pop(application, []), _tables.pop(application, [])
    try:
        yield
    finally:
        drop_staged(spark)
        _staged[application], _tables[application] = outer, outer_tables


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of an action go when it ends, not when the driver's garbage happens to be collected.

    For passes whose results are all staged or collected: a frame that runs twice shuffles twice.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Multi-pass operators (quantile edges, then ranks, then the result) run on the staged
    copy, so the expensive lineage is computed once, and a lost executor costs a re-read
    of files instead of a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, column: str, label: str = "bucketed") -> DataFrame:
    """Like ``stage``, but with the rows bucketed by ``column``: joins and groupings on it need no shuffle of this side.

    There are as many buckets as shuffle partitions, so the other side is dealt out likewise. The copy is a table of
    the session's catalogue whose files lie in the shared folder.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    _tables.setdefault(spark.sparkContext.applicationId, []).append(name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.bucketBy(buckets, column).sortBy(column).option("path", path).option("compression", "zstd")
    writer.saveAsTable(name)
    return spark.table(name)
