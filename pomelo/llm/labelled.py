"""Training rows and model transport shared by the two classifiers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bound_batches, held_out

SEED = 17
_SPAN = 2**40


def training_ids(labels: DataFrame, column: str, most: dict[int, int]) -> DataFrame:
    """``doc_id, y, draw`` of about ``most[y]`` rows of each class at most, drawn by a hash of the id.

    Rows of the held-out fold, rows without an id and without a label are left out; a document that
    is labelled more than once counts once, with its largest label.
    """
    rows = (labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(*most) & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max(column).cast("int").alias("y")))
    found = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(_SPAN)) / float(_SPAN)
    share = F.lit(0.0)
    for y, n in found.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, most[y] / n))).otherwise(share)
    return rows.withColumn("draw", draw).filter(F.col("draw") < share)


def train(docs: DataFrame, labels: DataFrame, column: str, most: dict[int, int],
          features: Callable[[str], bytes], fit: Callable[[list[bytes], list[int]], bytes],
          doc_id: str = "doc_id", text: str = "text") -> bytes | None:
    """A model fitted in one task to a bounded number of labelled documents; None without both classes.

    Texts become packed features where they are read, whole texts always; only those of the sample
    meet in the task that fits, and only the model, of fixed size, comes to the driver.
    """
    bound_batches(docs.sparkSession)
    ids = training_ids(labels, column, most)
    # at most about sum(most) rows of three numbers, whatever the size of the tables
    rows = (docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
            .join(F.broadcast(ids), "doc_id").select("y", "draw", "text"))

    def pack(batches):
        for batch in batches:
            packed = pa.array([features(x.as_py()) for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("draw"), packed], names=["y", "draw", "packed"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["draw", "packed"])  # rows arrive in any order
        y = part["y"].tolist()
        if len(set(y)) < 2:
            return pd.DataFrame({"model": []}, dtype=object)
        return pd.DataFrame({"model": [fit(part["packed"].tolist(), y)]})

    models = (rows.mapInArrow(pack, "y int, draw double, packed binary").groupBy(F.lit(0).alias("all"))
              .applyInPandas(run, "model binary").collect())
    return bytes(models[0]["model"]) if models else None


def scored(docs: DataFrame, model: bytes | None, score: Callable[[bytes, list[str]], "list[float]"], at: float,
           text: str = "text", without: float = 0.0) -> DataFrame:
    """``docs`` with a struct ``scored`` of score and predicted; ``without`` is the score if there is no
    model. Rows stay whole and where they are, so a filter on the struct needs no join."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def margin(texts: pd.Series) -> pd.Series:
        values = ["" if t is None else t for t in texts]
        return pd.Series(score(shared.value, values) if shared.value is not None else [without] * len(values), dtype="float64")

    # a column of this name would hide one of the table's own
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), margin(F.col(f"`{text}`")).alias("score"))
    return rows.select("row", "score", (F.col("score") >= at).cast("int").alias("predicted"))


def apply(docs: DataFrame, model: bytes | None, score: Callable[[bytes, list[str]], "list[float]"], at: float,
          doc_id: str = "doc_id", text: str = "text", without: float = 0.0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = scored(narrow, model, score, at, "text", without)
    return rows.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


def passing(docs: DataFrame, model: bytes | None, score: Callable[[bytes, list[str]], "list[float]"], at: float,
            wanted: int, text: str = "text", without: float = 0.0) -> DataFrame:
    """Rows of ``docs``, with their own columns, that are predicted to be ``wanted``."""
    return scored(docs, model, score, at, text, without).filter(F.col("predicted") == wanted).select("row.*")
