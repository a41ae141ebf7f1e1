"""Tables over run records, metric tables and resource samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import numeric as N

PHASES = ("t_load", "t_sbert", "t_graph", "t_train", "t_eval")


def phase_means(runs: DataFrame, by: str, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """Mean phase times by worker count or dataset size."""
    present = [p for p in phases if p in runs.columns]
    return runs.groupBy(by).agg(*[F.avg(p).alias(p) for p in present])


def metric_matrix(runs: DataFrame, metric: str, sizes: list[str]) -> DataFrame:
    """Mean metric with a row per model and a column per listed size."""
    return runs.groupBy("model").pivot("size_tag", sizes).agg(F.avg(metric))


def best_runs(runs: DataFrame, metric: str = "ndcg", tie: str = "run") -> DataFrame:
    """Best run per model and size; the smaller run name wins a tie."""
    top = Window.partitionBy("model", "size_tag").orderBy(F.col(metric).desc(), tie)
    return (runs.withColumn("_rank", F.row_number().over(top)).filter(F.col("_rank") <= 1)
            .select("model", "size_tag", metric, tie))


def leaderboard(runs: DataFrame, metric: str = "ndcg", tie: str = "run") -> DataFrame:
    """All runs, best first, with their grade."""
    return runs.withColumn("grade", N.grade(metric)).orderBy(F.col(metric).desc(), tie)


def window_stats(samples: DataFrame, markers: DataFrame, by: str = "run") -> DataFrame:
    """Mean, max, min and number of samples between the start and the end of each phase.

    ``samples`` is (run, ts, value), ``markers`` (run, phase, t0, t1) with few phases per
    run; the join is on the run, and AQE splits a run with very many samples.
    """
    inside = samples.join(markers, by).filter((F.col("ts") >= F.col("t0")) & (F.col("ts") <= F.col("t1")))
    return inside.groupBy(by, "phase").agg(
        N.round_even(N.settle(F.avg("value")), 2).alias("mean_value"), N.round_even(F.max("value"), 2).alias("max_value"),
        N.round_even(F.min("value"), 2).alias("min_value"), F.count(F.lit(1)).alias("n_samples"))


def relative_speed(runs: DataFrame, time: str = "t_train") -> DataFrame:
    """Mean speed-up per worker count and model against the fewest workers seen anywhere."""
    fewest = runs.select(F.min("n_workers")).scalar()
    base = (runs.filter(F.col("n_workers") == fewest).groupBy("size_tag", "model")
            .agg(F.avg(time).alias("_base")))
    return (runs.join(base, ["size_tag", "model"])
            .groupBy("n_workers", "model").agg(F.avg(F.try_divide(F.col("_base"), F.col(time))).alias("speedup")))


def speed_table(runs: DataFrame, time: str = "t_train") -> DataFrame:
    """Speed-up and efficiency of every (model, size, workers) against one worker.

    Without a one-worker time the speed-up is 1.
    """
    per = runs.groupBy("model", "size_tag", "n_workers").agg(F.avg(time).alias("seconds"))
    base = per.filter(F.col("n_workers") == 1).select("model", "size_tag", F.col("seconds").alias("_base"))
    speed = F.when(F.col("_base") > 0, N.speedup("_base", "seconds")).otherwise(F.lit(1.0))
    return (per.join(base, ["model", "size_tag"], "left").withColumn("speedup", speed)
            .withColumn("efficiency", N.efficiency("speedup", "n_workers")).drop("_base"))


def key_figures(runs: DataFrame, ndcg: str = "ndcg") -> DataFrame:
    """Number of runs, best speed-up beyond one worker and best NDCG of one-worker runs."""
    speeds = speed_table(runs)
    best = speeds.filter(F.col("n_workers") > 1).select(F.max("speedup")).scalar()
    quality = runs.filter(F.col("n_workers") == 1).select(F.max(ndcg)).scalar()
    return runs.agg(F.count(F.lit(1)).alias("total_runs")).select(
        "total_runs", F.coalesce(best, F.lit(1.0)).alias("best_speedup"),
        F.coalesce(quality, F.lit(0.0)).alias("best_ndcg"))


def metric_deltas(reference: DataFrame, current: DataFrame, tolerance: float = 0.011) -> DataFrame:
    """Difference of two long metric tables (run, k, metric, value) and whether it is small."""
    left = reference.select("run", "k", "metric", F.col("value").alias("reference"))
    right = current.select("run", "k", "metric", F.col("value").alias("current"))
    return (left.join(right, ["run", "k", "metric"])
            .withColumn("delta", F.col("current") - F.col("reference"))
            .withColumn("ok", F.abs("delta") <= tolerance))


def model_table(metrics: DataFrame, models: list[str]) -> DataFrame:
    """One row per metric and K with a column per model; ``metrics`` is (model, k, metric, value)."""
    return metrics.groupBy("metric", "k").pivot("model", models).agg(F.avg("value"))


# The trial grid of the incremental search.
TRIAL_EPOCHS = (5, 10, 20, 30, 50)
TRIAL_LR_SCALES = (0.01, 0.05, 0.1, 0.2)
TRIAL_REPLAY = (0.0, 0.1, 0.2, 0.3, 0.5)


def trial_grid(spark) -> DataFrame:
    """All 100 settings, numbered."""
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    grid = (spark.range(1).select(F.explode(listed(TRIAL_EPOCHS)).alias("epochs"))
            .select("epochs", F.explode(listed(TRIAL_LR_SCALES)).alias("lr_scale"))
            .select("epochs", "lr_scale", F.explode(listed(TRIAL_REPLAY)).alias("replay_ratio")))
    pos = lambda values, c: F.array_position(listed(values), F.col(c)) - 1
    number = ((pos(TRIAL_EPOCHS, "epochs") * len(TRIAL_LR_SCALES) + pos(TRIAL_LR_SCALES, "lr_scale"))
              * len(TRIAL_REPLAY) + pos(TRIAL_REPLAY, "replay_ratio"))
    return grid.select(number.alias("trial"), "epochs", "lr_scale", "replay_ratio")


def rank_trials(grid: DataFrame, metrics: DataFrame, alpha: float = 0.6) -> DataFrame:
    """Trials by ``alpha * composite(new data) + (1 - alpha) * composite(old data)``.

    ``metrics`` is (trial, data in {new, old}, NDCG, P, R); missing old data counts 0.
    """
    value = N.composite("NDCG", "P", "R")
    per = metrics.groupBy("trial").agg(
        F.avg(F.when(F.col("data") == "new", value)).alias("new_score"),
        F.avg(F.when(F.col("data") == "old", value)).alias("old_score"))
    score = (F.lit(alpha) * F.coalesce("new_score", F.lit(0.0))
             + F.lit(1.0 - alpha) * F.coalesce("old_score", F.lit(0.0)))
    return grid.join(per, "trial").withColumn("score", score).orderBy(F.col("score").desc(), "trial")


def wide_runs(runs: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """One flat row per nested run record (``sources.runs.RUN_RECORD``)."""
    rank = lambda k, m: F.try_element_at(F.col("test_metrics.ranking"), F.lit(str(k)))[m]
    return runs.select(
        "size_tag", "model", "n_workers", "n_partitions", "n_users", "n_items", "n_edges",
        F.when(F.col("n_partitions") == 1, "standard").otherwise("bigdata").alias("mode"),
        F.coalesce("spark_timings.t_total_spark", "spark_timings.t_total_pandas").alias("t_preprocess"),
        *[F.col(f"spark_timings.{c}").alias(f"{c}_spark") for c in ("t_load", "t_filter", "t_graph")],
        *[F.col(f"timings.{c}").alias(c) for c in (*PHASES, "t_total")],
        F.col("resources.train.gpu_util_pct.mean").alias("gpu_util_mean"),
        F.col("resources.train.gpu_mem_used_mb.max").alias("gpu_mem_max_mb"),
        *[rank(k, "NDCG").alias(f"ndcg@{k}") for k in ks],
        rank(10, "R").alias("recall@10"), rank(10, "P").alias("precision@10"), rank(10, "HR").alias("hr@10"),
        rank(10, "MAP").alias("map@10"), rank(10, "MRR").alias("mrr@10"),
        F.col("test_metrics.rmse").alias("rmse"), F.col("test_metrics.mae").alias("mae"),
        rank(10, "n_eval_users").alias("n_eval_users@10"))
