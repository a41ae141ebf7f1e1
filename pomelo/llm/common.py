"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Bytes of one Arrow batch that Spark hands to a Python worker. Rows are cut into batches by this
# size as well as by number, so a run of very long texts does not pile up in one batch.
BATCH_BYTES = "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with ``value`` computed once, also when ``body`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: Column) -> Column:
    """Fold of a document: crc32 of the id as text, modulo 3, is 1. False for a missing id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
