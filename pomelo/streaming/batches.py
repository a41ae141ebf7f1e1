"""Review batches as a stream: each micro-batch extends the ids and is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import encode
from .ids import IdLog


def id_logs(spark: SparkSession, root: str) -> tuple[IdLog, IdLog]:
    """Ids of users and of items."""
    return IdLog(spark, f"{root}/users", "user_id", "user_idx"), IdLog(spark, f"{root}/items", "item_id", "item_idx")


def process_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """Extend users and items by the batch's new keys and write the encoded rows.

    A batch writes its new keys and its own rows, whatever the number of known ids. The ids remember the
    batch; the encoded rows carry its number in their folder and are replaced when it is repeated.
    """
    users, items = id_logs(batch.sparkSession, root)
    users.extend(batch, batch_id)
    items.extend(batch, batch_id)
    both = encode.transform_ids(encode.transform_ids(batch, users.of(batch), "user_id", "user_idx"), items.of(batch), "item_id", "item_idx")
    rows = both.withColumn("item_node", F.col("item_idx") + F.lit(users.size())).withColumn("rating", F.col("rating").cast("double"))
    rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/encoded/batch_id={batch_id}")


def review_stream(reviews: DataFrame, root: str, checkpoint: str, every: str | None = None, wrap=lambda write: write):
    """Encode a stream of reviews. ``wrap`` may wrap the function that writes a batch."""
    write = wrap(lambda df, batch_id: process_batch(df, batch_id, root))
    writer = reviews.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()
