"""Prepared edges, items and run metadata in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import written

EDGE_SCHEMA = "user_idx long, item_idx long, rating int, date date, review_id string, split string"
ITEM_SCHEMA = "item_idx long, categories string, business_id string"
META_SCHEMA = T.StructType([
    T.StructField("size_tag", T.StringType()),
    T.StructField("n_users", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("n_edges", T.LongType()),
    T.StructField("split_counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("timings", T.MapType(T.StringType(), T.DoubleType())),
])


def write_table(df: DataFrame, path: str, files: int | None = None, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrite a parquet folder; ``files`` bounds the file count for small tables."""
    writer = (df if files is None else df.coalesce(files)).write.mode("overwrite").option("compression", "zstd")
    with written(df.sparkSession):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def item_catalogue(businesses: DataFrame, item_ids: DataFrame) -> DataFrame:
    """(item_idx, categories, business_id) of the businesses that have an id."""
    return (businesses.join(item_ids, "item_id")
            .select("item_idx", "categories", F.col("item_id").cast("string").alias("business_id")))


def meta_row(edges: DataFrame, size_tag: str, timings: dict[str, float]) -> DataFrame:
    """One row describing prepared edges."""
    sizes = edges.agg((F.max("user_idx") + 1).alias("n_users"), (F.max("item_idx") + 1).alias("n_items"),
                      F.count(F.lit(1)).alias("n_edges"))
    parts = edges.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    counts = parts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "n")))).alias("m"))
    spent = F.create_map(*[F.lit(x) for pair in timings.items() for x in pair]) if timings \
        else F.lit(None)
    return sizes.select(F.lit(size_tag).alias("size_tag"), "n_users", "n_items", "n_edges",
                        counts.scalar().alias("split_counts"),
                        spent.cast("map<string,double>").alias("timings"))


def write_meta(meta: DataFrame, path: str) -> None:
    meta.write.mode("overwrite").json(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META_SCHEMA).json(path)


def load_prepared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, items, sizes) of a folder; sizes come from the metadata or, without it, from the edges."""
    edges = spark.read.schema(EDGE_SCHEMA).parquet(f"{folder}/edges")
    items = spark.read.schema(ITEM_SCHEMA).parquet(f"{folder}/items")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/meta")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        sizes = read_meta(spark, f"{folder}/meta").select("n_users", "n_items", "n_edges")
    else:
        sizes = edges.agg((F.max("user_idx") + 1).alias("n_users"),
                          (F.max("item_idx") + 1).alias("n_items"), F.count(F.lit(1)).alias("n_edges"))
    return edges, items, sizes
