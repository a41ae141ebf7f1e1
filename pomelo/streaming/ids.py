"""Dense ids as an append-only log.

New keys get the next numbers, in ascending order of key within a batch. A batch writes its new keys
only, dealt out to hash buckets, and looks for known ones in the buckets of its own keys. Parts of
about equal size are folded now and then. A commit log names the parts and the batches that are in, so a
repeated batch finds its keys numbered as they were.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.encode import dense_ids
from ..session import materialize
from ..sources.commits import CommitLog, Conflict, folder_name, to_fold

BUCKETS, MOST_PARTS = 64, 8


class IdLog:
    def __init__(self, spark: SparkSession, path: str, key: str, idx: str, buckets: int = BUCKETS, most_parts: int = MOST_PARTS) -> None:
        self._spark, self.path, self._key, self._idx = spark, path, key, idx
        self._first, self._most = buckets, most_parts
        self._log = CommitLog(spark, path)

    def _state(self) -> tuple[int, dict]:
        at = self._log.latest()
        return at, self._log.read(at) if at >= 0 else {"buckets": self._first, "next": 0, "batches": {}, "live": {}}

    def size(self) -> int:
        """Number of keys; the next id."""
        return self._state()[1]["next"]

    def _bucketed(self, keys: DataFrame, buckets: int) -> DataFrame:
        return keys.withColumn("bucket", F.pmod(F.xxhash64(self._key), F.lit(buckets)).cast("int"))

    def _read(self, schema: StructType, live: dict, buckets) -> DataFrame:
        folders = [f"{self.path}/data/part={p}/bucket={b}" for b in buckets for p, _ in live.get(str(b), [])]
        if not folders:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders)

    def _write(self, rows: DataFrame) -> tuple[str, dict[str, int]]:
        part = folder_name()
        folder = f"{self.path}/data/part={part}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        counts = self._spark.read.schema(rows.schema).parquet(folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
        return part, {str(r["bucket"]): r["n"] for r in counts}

    def table(self) -> DataFrame:
        """All keys and their ids."""
        _, state = self._state()
        return self._read(StructType.fromJson(state["schema"]), state["live"], range(state["buckets"])).select(self._key, self._idx)

    def of(self, values: DataFrame) -> DataFrame:
        """Ids from the buckets that the keys of ``values`` lie in."""
        _, state = self._state()
        touched = self._bucketed(values.select(self._key), state["buckets"]).select("bucket").distinct().collect()  # at most the buckets
        return self._read(StructType.fromJson(state["schema"]), state["live"], [r["bucket"] for r in touched]).select(self._key, self._idx)

    def extend(self, values: DataFrame, batch_id: int, writer: str = "stream") -> None:
        """Number the keys of ``values`` that have no id; nothing to do if ``writer`` has committed the batch.
        Rows without a key are left out."""
        keys = None
        while True:
            at, state = self._state()
            if batch_id <= state["batches"].get(writer, -1):
                return
            if keys is None:
                distinct = values.select(self._key).filter(F.col(self._key).isNotNull()).distinct()
                keys = materialize(self._bucketed(distinct, state["buckets"]), "keys")
                schema = keys.select(self._key, F.lit(0).cast("long").alias(self._idx), "bucket").schema
            touched = [r["bucket"] for r in keys.select("bucket").distinct().collect()]
            known = self._read(schema, state["live"], touched).select(self._key, "bucket")
            fresh = keys.join(known, [self._key, "bucket"], "left_anti")
            added = dense_ids(fresh, self._key, self._idx).select(self._key, (F.col(self._idx) + state["next"]).alias(self._idx))
            part, counts = self._write(self._bucketed(added, state["buckets"]))
            live, folds = {b: [tuple(p) for p in v] for b, v in state["live"].items()}, {}
            for b, n in counts.items():
                live[b] = [*live.get(b, []), (part, n)]
                folded = to_fold(live[b], self._most)
                if folded:
                    folds[b] = folded
                    live[b] = [p for p in live[b] if p not in folded]
            if folds:
                merged, sizes = self._write(self._read(schema, folds, list(folds)).select(self._key, self._idx, "bucket"))
                for b, n in sizes.items():
                    live[b] = [(merged, n), *live[b]]
            try:
                self._log.commit(at + 1, {"buckets": state["buckets"], "next": state["next"] + sum(counts.values()), "live": live,
                                          "batches": {**state["batches"], writer: batch_id}, "schema": json.loads(schema.json())})
                return
            except Conflict:
                continue  # another writer was first: look again for what is new

    def vacuum(self, keep: int = 2) -> None:
        """Keep the newest commits and delete the parts that none of them names."""
        self._log.forget(keep)
        named = {p for n in self._log.numbers() for parts in self._log.read(n)["live"].values() for p, _ in parts}
        for folder in self._log.folders("data"):
            if folder.removeprefix("part=") not in named:
                self._log.delete(f"data/{folder}")
