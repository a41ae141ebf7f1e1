"""Metric files of finished runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RANKING = "map<string, struct<P:double,R:double,F1:double,NDCG:double,MRR:double,HR:double,MAP:double,n_eval_users:double>>"
TIMINGS = ("struct<t_load:double,t_sbert:double,t_graph:double,t_train:double,t_eval:double,"
           "t_total:double,world_size:double,loader:string>")
METRICS_SCHEMA = (f"rmse double, mae double, accuracy double, global_precision double, ranking {RANKING}, "
                  f"ranking_kfiltered {RANKING}, timings {TIMINGS}")
_STATS = "struct<mean:double,max:double,min:double>"
RUN_RECORD = (
    "size_tag string, model string, n_workers long, n_partitions long, n_users long, n_items long, n_edges long, "
    f"timings {TIMINGS}, "
    "spark_timings struct<t_load:double,t_filter:double,t_graph:double,t_total_spark:double,t_total_pandas:double>, "
    f"test_metrics struct<rmse:double,mae:double,accuracy:double,global_precision:double,ranking:{RANKING}>, "
    f"resources struct<train:struct<gpu_util_pct:{_STATS},gpu_mem_used_mb:{_STATS}>>")

# Fixed value: run folders are named model_w<workers>_<size>.
RUN_NAME = r"(gat|sage|lightgcn)_w(\d+)_([^/]+)"


def write_metrics(spark: SparkSession, folder: str, run: str, scores: dict, rankings: dict[str, DataFrame],
                  timings: dict[str, float]) -> str:
    """Write the metric file of a run as :func:`read_metrics` reads it, and return its folder.

    ``rankings`` has metric tables of a few rows, one per K, under "ranking" and "ranking_kfiltered".
    """
    as_map = lambda table: {str(r["k"]): {n: float(r[n]) for n in ("P", "R", "F1", "NDCG", "MRR", "HR", "MAP", "n_eval_users")}
                            for r in table.collect()}
    row = {**{k: scores.get(k) for k in ("rmse", "mae", "accuracy", "global_precision")},
           **{k: as_map(t) for k, t in rankings.items()}, "timings": timings}
    path = f"{folder}/{run}"
    spark.createDataFrame([row], METRICS_SCHEMA).coalesce(1).write.mode("overwrite").json(path)
    return path


def parse_run(name: Column) -> list[Column]:
    """run, model, n_workers and size_tag out of a run name or a path that contains one."""
    part = lambda i: F.regexp_extract(name, RUN_NAME, i)
    return [part(0).alias("run"), part(1).alias("model"), part(2).try_cast("int").alias("n_workers"),
            part(3).alias("size_tag")]


def read_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per metric file, with its run taken from the folder name; other files are left out."""
    df = (spark.read.schema(METRICS_SCHEMA).option("multiLine", "true").json(pattern)
          .withColumn("_path", F.input_file_name()))
    return df.select(*parse_run(F.col("_path")), *[c for c in df.columns if c != "_path"]).filter(F.col("run") != "")


def read_run_records(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Nested run records, one per line, or one indented record (or list of them) per file."""
    return spark.read.schema(RUN_RECORD).option("multiLine", str(one_per_file).lower()).json(path)


def flatten_ranking(metrics: DataFrame, column: str = "ranking") -> DataFrame:
    """(run, model, n_workers, size_tag, rmse, mae, k, P, R, F1, NDCG, MRR, HR, MAP, n_eval_users)."""
    keys = [c for c in ("run", "model", "n_workers", "size_tag", "rmse", "mae") if c in metrics.columns]
    return (metrics.select(*keys, F.explode(column).alias("_k", "_m"))
            .select(*keys, F.col("_k").cast("long").alias("k"), "_m.*"))
