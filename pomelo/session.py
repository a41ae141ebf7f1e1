"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings a job of this package runs well with. Partition counts and memory are
# left to the cluster: AQE coalesces and splits shuffle partitions at run time.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # vector work is heavy per byte: keep every core busy on small shuffles, too
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # packed blocks of vectors are big rows: bound Arrow batches by bytes
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def build_session(app_name: str = "pomelo", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else the session's warehouse, unless that is a
    folder of one machine and the executors run on others."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    one_machine = spark.sparkContext.master.startswith("local")
    if warehouse and (one_machine or not warehouse.startswith(("file:", "/"))):
        return warehouse.rstrip("/")
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path no other run uses, so a retried job never reads half-written data."""
    return f"{shared_dir(spark)}/pomelo/{label}-{uuid.uuid4().hex}"


class TemporaryTables:
    """Tables written by :func:`materialize` inside a ``with`` block are deleted at its end,
    unless kept. For jobs, and for loops whose every round replaces the tables of the last one.
    Blocks nest; each thread has its own."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._paths = spark, []

    def __enter__(self) -> "TemporaryTables":
        self._token = _OPEN.set((*_OPEN.get(), self))
        return self

    def keep(self, df: DataFrame) -> str:
        """Take the table written last out of the deletion and return its path; an enclosing block
        deletes it."""
        path = self._paths.pop()
        if path not in df.inputFiles()[0]:
            raise ValueError("keep() takes the table written last")
        outer = _OPEN.get()[:-1]
        if outer:
            outer[-1]._paths.append(path)
        return path

    def __exit__(self, *_error) -> None:
        _OPEN.reset(self._token)
        for path in self._paths:
            delete_table(self._spark, path)


_OPEN: ContextVar[tuple[TemporaryTables, ...]] = ContextVar("open_temporary_tables", default=())


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table below the shared folder."""
    if not path.startswith(f"{shared_dir(spark)}/pomelo/"):
        raise ValueError(f"{path} is no intermediate table")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def written(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go at its end; else they stay until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str = "table",
                partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and lets later readers
    prune columns, which a row checkpoint would not.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if codec:
        writer = writer.option("compression", codec)
    with written(spark):
        writer.parquet(path)
    if _OPEN.get():
        _OPEN.get()[-1]._paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
