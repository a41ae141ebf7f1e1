"""Run records, metric tables and resource samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import report, training
from ..session import fresh_path
from ..sources import runs as run_files
from . import domain as D, sqltext as S
from .registry import query

R = f"WITH {S.RUNS}"


@query("phase_means_by_workers", "A10", f"""{R} SELECT n_workers, {S.r6('avg(t_load)')} AS t_load, {S.r6('avg(t_graph)')} AS t_graph,
  {S.r6('avg(t_train)')} AS t_train, {S.r6('avg(t_eval)')} AS t_eval FROM runs GROUP BY n_workers""")
def phase_means_by_workers(spark, sf):
    m = report.phase_means(D.runs(spark, sf), "n_workers")
    return m.select("n_workers", *[N.r6(c).alias(c) for c in m.columns if c != "n_workers"])


@query("phase_means_by_size", "A10 F23", f"""{R} SELECT size_tag, CASE size_tag WHEN 'full' THEN 0 ELSE CAST(replace(size_tag, 'k', '000') AS BIGINT) END AS size_number,
  {S.r6('avg(t_train)')} AS t_train FROM runs GROUP BY size_tag""")
def phase_means_by_size(spark, sf):
    m = report.phase_means(D.runs(spark, sf), "size_tag", ("t_train",))
    return m.select("size_tag", N.size_number("size_tag").alias("size_number"), N.r6("t_train").alias("t_train"))


@query("metric_matrix", "A11", f"""{R} SELECT model, """ + ", ".join(
    f"""{S.r6(f"avg(ndcg) FILTER (WHERE size_tag = '{t}')")} AS "{t}" """ for t in D.SIZE_TAGS) + "FROM runs GROUP BY model")
def metric_matrix(spark, sf):
    m = report.metric_matrix(D.runs(spark, sf), "ndcg", list(D.SIZE_TAGS))
    return m.select("model", *[N.r6(F.col(f"`{t}`")).alias(t) for t in D.SIZE_TAGS])


@query("best_runs", "A12", f"""{R} SELECT model, size_tag, ndcg, run FROM (SELECT *, row_number() OVER (PARTITION BY model, size_tag ORDER BY ndcg DESC, run) AS rn FROM runs) WHERE rn = 1""")
def best_runs(spark, sf):
    return report.best_runs(D.runs(spark, sf))


@query("phase_window_stats", "A13", f"""WITH m AS (SELECT user_id AS run, 'active' AS phase, min(ts) FILTER (WHERE event_type = 'signup') AS t0,
  max(ts) FILTER (WHERE event_type = 'purchase') AS t1 FROM events GROUP BY user_id
  UNION ALL SELECT user_id, 'errors', min(ts), max(ts) FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT e.user_id AS run, m.phase, {S.even(S.r9('avg(value)'), 2)} AS mean_value, {S.even('max(value)', 2)} AS max_value, {S.even('min(value)', 2)} AS min_value, count(*) AS n_samples
FROM events e JOIN m ON e.user_id = m.run AND e.ts BETWEEN m.t0 AND m.t1 GROUP BY e.user_id, m.phase""")
def phase_window_stats(spark, sf):
    e = D.table(spark, sf, "events").withColumnRenamed("user_id", "run")
    at = lambda how, kind: how(F.when(F.col("event_type") == kind, F.col("ts")))
    active = e.groupBy("run").agg(F.lit("active").alias("phase"), at(F.min, "signup").alias("t0"),
                                  at(F.max, "purchase").alias("t1"))
    errors = e.filter(F.col("event_type") == "error").groupBy("run").agg(
        F.lit("errors").alias("phase"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    return report.window_stats(e.select("run", "ts", "value"), active.unionByName(errors))


@query("relative_speed", "J11", f"""{R}, b AS (SELECT size_tag, model, avg(t_train) AS base FROM runs WHERE n_workers = (SELECT min(n_workers) FROM runs) GROUP BY 1, 2)
SELECT n_workers, model, {S.r6('avg(base/t_train)')} AS speedup FROM runs JOIN b USING (size_tag, model) GROUP BY 1, 2""")
def relative_speed(spark, sf):
    return report.relative_speed(D.runs(spark, sf)).select("n_workers", "model", N.r6("speedup").alias("speedup"))


SPEEDS = f"""per AS (SELECT model, size_tag, n_workers, avg(t_train) AS seconds FROM runs GROUP BY 1, 2, 3),
base AS (SELECT model, size_tag, seconds AS b FROM per WHERE n_workers = 1),
speeds AS (SELECT per.*, CASE WHEN b > 0 THEN CASE WHEN seconds > 0 THEN {S.even(S.r9('b/seconds'), 2)} ELSE 0.0 END ELSE 1.0 END AS speedup FROM per LEFT JOIN base USING (model, size_tag))"""


@query("speed_table", "M13 F21", f"""{R}, {SPEEDS} SELECT model, size_tag, n_workers, {S.r6('seconds')} AS seconds, speedup, {S.even('speedup/n_workers*100.0::DOUBLE', 1)} AS efficiency FROM speeds""")
def speed_table(spark, sf):
    return report.speed_table(D.runs(spark, sf)).withColumn("seconds", N.r6("seconds"))


@query("key_figures", "M14", f"""{R}, {SPEEDS} SELECT count(*) AS total_runs, (SELECT max(speedup) FROM speeds WHERE n_workers > 1) AS best_speedup,
  max(ndcg) FILTER (WHERE n_workers = 1) AS best_ndcg FROM runs""")
def key_figures(spark, sf):
    return report.key_figures(D.runs(spark, sf))


NAME = "model||'_w'||n_workers||'_'||size_tag"
HALVES = f"""h AS (SELECT {NAME} AS run, [5,10,20][k_prop%3+1] AS k, ['P','R','NDCG'][run%3+1] AS metric, ts < TIMESTAMP '2024-01-16' AS early, avg(t_eval)/10 AS value FROM runs GROUP BY ALL)"""


def _halves(spark, sf):
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    r = D.runs(spark, sf).select(
        D.run_name().alias("run"), pick(("P", "R", "NDCG"), F.pmod("run", F.lit(3))).alias("metric"),
        pick((5, 10, 20), F.pmod("k_prop", F.lit(3))).alias("k"),
        (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("early"), "t_eval")
    return r.groupBy("run", "k", "metric", "early").agg((F.avg("t_eval") / 10).alias("value"))


@query("metric_deltas", "J12", f"""{R}, {HALVES} SELECT a.run, a.k, a.metric, {S.r6('a.value')} AS reference, {S.r6('b.value')} AS current,
  {S.r6('b.value-a.value')} AS delta, abs(b.value-a.value) <= 0.011 AS ok FROM h a JOIN h b ON a.run = b.run AND a.k = b.k AND a.metric = b.metric AND a.early AND NOT b.early""")
def metric_deltas(spark, sf):
    h = _halves(spark, sf)
    d = report.metric_deltas(h.filter("early"), h.filter("not early"))
    return d.select("run", "k", "metric", *[N.r6(c).alias(c) for c in ("reference", "current", "delta")], "ok")


@query("model_table", "M12", f"""{R}, {HALVES}, s AS (SELECT split_part(run, '_', 1) AS model, k, metric, value FROM h)
SELECT metric, k, """ + ", ".join(f"""{S.r6(f"avg(value) FILTER (WHERE model = '{m}')")} AS {m}""" for m in D.MODELS) + " FROM s GROUP BY metric, k")
def model_table(spark, sf):
    rows = _halves(spark, sf).withColumn("model", F.substring_index("run", "_", 1))
    t = report.model_table(rows, list(D.MODELS))
    return t.select("metric", "k", *[N.r6(m).alias(m) for m in D.MODELS])


GRADE = "CASE WHEN ndcg = 0 THEN 'NUL' WHEN ndcg < 0.003 THEN 'TRES FAIBLE' WHEN ndcg < 0.006 THEN 'FAIBLE' WHEN ndcg < 0.008 THEN 'LIMITE' WHEN ndcg < 0.015 THEN 'ACCEPTABLE' ELSE 'BON' END"


@query("leaderboard", "T13 F20", f"""{R} SELECT run, model, n_workers, size_tag, ndcg, {GRADE} AS grade FROM runs""")
def leaderboard(spark, sf):
    return report.leaderboard(D.runs(spark, sf).select("run", "model", "n_workers", "size_tag", "ndcg"))


@query("trial_ranking", "M15 F19", f"""{R}, t AS (SELECT run%100 AS trial, CASE WHEN run%3 = 0 THEN 'old' ELSE 'new' END AS data,
  0.4::DOUBLE*ndcg+0.3::DOUBLE*(t_graph/10)+0.3::DOUBLE*(t_eval/10) AS c FROM runs),
p AS (SELECT trial, avg(c) FILTER (WHERE data = 'new') AS n, avg(c) FILTER (WHERE data = 'old') AS o FROM t GROUP BY trial),
g AS (SELECT (e*4+l)*5+r AS trial, [5,10,20,30,50][e+1] AS epochs, CAST(list_extract([0.01,0.05,0.1,0.2], l+1) AS DOUBLE) AS lr_scale, CAST(list_extract([0.0,0.1,0.2,0.3,0.5], r+1) AS DOUBLE) AS replay_ratio FROM range(5) a(e), range(4) b(l), range(5) c(r))
SELECT g.trial, g.epochs, g.lr_scale, g.replay_ratio, {S.r6('0.6::DOUBLE*coalesce(n,0.0)+(1.0::DOUBLE-0.6::DOUBLE)*coalesce(o,0.0)')} AS score FROM g JOIN p USING (trial)""")
def trial_ranking(spark, sf):
    m = D.runs(spark, sf).select(
        F.pmod("run", F.lit(100)).alias("trial"), F.when(F.pmod("run", F.lit(3)) == 0, "old").otherwise("new").alias("data"),
        F.col("ndcg").alias("NDCG"), (F.col("t_graph") / 10).alias("P"), (F.col("t_eval") / 10).alias("R"))
    ranked = report.rank_trials(report.trial_grid(spark), m)
    return ranked.select("trial", "epochs", "lr_scale", "replay_ratio", N.r6("score").alias("score"))


@query("early_stopping", "W9", """WITH RECURSIVE log AS (SELECT user_id AS run, CAST(floor((epoch(ts)-epoch(TIMESTAMP '2024-01-01'))/3600) AS BIGINT)+1 AS epoch, avg(value) AS score FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM log),
fold AS (SELECT run, i, score AS best, epoch AS best_epoch, 0 AS waited, CAST(NULL AS BIGINT) AS stop_epoch FROM o WHERE i = 1
  UNION ALL SELECT o.run, o.i, CASE WHEN o.score > f.best+1e-5::DOUBLE THEN o.score ELSE f.best END,
    CASE WHEN o.score > f.best+1e-5::DOUBLE THEN o.epoch ELSE f.best_epoch END, CASE WHEN o.score > f.best+1e-5::DOUBLE THEN 0 ELSE f.waited+1 END,
    CASE WHEN NOT o.score > f.best+1e-5::DOUBLE AND f.waited+1 >= 5 THEN o.epoch END
  FROM fold f JOIN o ON o.run = f.run AND o.i = f.i+1 WHERE f.stop_epoch IS NULL)
SELECT run, floor(best*1e6+0.5::DOUBLE)/1e6 AS best_score, best_epoch, stop_epoch FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY i DESC) AS last FROM fold) WHERE last = 1""")
def early_stopping(spark, sf):
    # one validation score per run and hour: an hour is the epoch
    e = D.table(spark, sf, "events")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))) / 3600)
    log = (e.select(F.col("user_id").alias("run"), (hour + 1).alias("epoch"), "value")
           .groupBy("run", "epoch").agg(F.avg("value").alias("score")))
    return training.early_stopping(log, patience=5).withColumn("best_score", N.r6("best_score"))


def _metric_files(spark, sf):
    """Metric files written per run, as finished runs leave them."""
    path = fresh_path(spark, "metrics")
    r = D.runs(spark, sf).withColumn("name", D.run_name())
    per = r.groupBy("name").agg(F.avg("t_train").alias("rmse"), F.avg("t_eval").alias("mae"),
                                *[F.avg(F.when(F.pmod("k_prop", F.lit(3)) == i, F.col("ndcg"))).alias(f"n{k}")
                                  for i, k in enumerate((5, 10, 20))])
    cell = lambda k: F.struct(F.col(f"n{k}").alias("NDCG"), (F.col(f"n{k}") / 2).alias("P"), F.col(f"n{k}").alias("R"),
                              F.col(f"n{k}").alias("HR"), F.lit(10.0).alias("n_eval_users"))
    ranking = F.create_map(*[x for k in (5, 10, 20) for x in (F.lit(str(k)), cell(k))])
    per.select("name", "rmse", "mae", ranking.alias("ranking")).write.partitionBy("name").json(path)
    return path


FILES = f"""f AS (SELECT {NAME} AS run, model, CAST(n_workers AS INTEGER) AS n_workers, size_tag, avg(t_train) AS rmse, avg(t_eval) AS mae,
  avg(ndcg) FILTER (WHERE k_prop%3 = 0) AS n5, avg(ndcg) FILTER (WHERE k_prop%3 = 1) AS n10, avg(ndcg) FILTER (WHERE k_prop%3 = 2) AS n20 FROM runs GROUP BY ALL)"""


@query("metric_files", "S9", f"""{R}, {FILES}, g AS (SELECT run, model, n_workers, size_tag, CAST(unnest([5,10,20]) AS BIGINT) AS k, unnest([n5,n10,n20]) AS "NDCG", rmse FROM f)
SELECT run, model, n_workers, size_tag, k, {S.r6('rmse')} AS rmse, {S.r6('"NDCG"')} AS "NDCG", {S.r6('"NDCG"/2')} AS "P" FROM g""")
def metric_files(spark, sf):
    flat = run_files.flatten_ranking(run_files.read_metrics(spark, f"{_metric_files(spark, sf)}/*"))
    return flat.select("run", "model", "n_workers", "size_tag", "k", *[N.r6(c).alias(c) for c in ("rmse", "NDCG", "P")])


@query("wide_runs", "M17", f"""{R}, {FILES}, w AS (SELECT size_tag, model, CAST(n_workers AS BIGINT) AS n_workers, CASE WHEN n_workers = 1 THEN 'standard' ELSE 'bigdata' END AS mode,
  {S.r6('rmse')} AS t_train, {S.r6('n5')} AS "ndcg@5", {S.r6('n10')} AS "ndcg@10", {S.r6('n10/2')} AS "precision@10", {S.r6('mae')} AS mae, {S.r6('mae*2')} AS gpu_util_mean FROM f)
SELECT * FROM w""")
def wide_runs(spark, sf):
    path = fresh_path(spark, "records")
    r = D.runs(spark, sf)
    per = r.groupBy("size_tag", "model", "n_workers").agg(
        F.avg("t_train").alias("t"), F.avg("t_eval").alias("e"),
        *[F.avg(F.when(F.pmod("k_prop", F.lit(3)) == i, F.col("ndcg"))).alias(f"n{k}") for i, k in enumerate((5, 10))])
    ranking = F.create_map(*[x for k in (5, 10) for x in (F.lit(str(k)), F.struct(
        F.col(f"n{k}").alias("NDCG"), (F.col(f"n{k}") / 2).alias("P")))])
    per.select("size_tag", "model", "n_workers", F.col("n_workers").alias("n_partitions"),
               F.struct(F.col("t").alias("t_train")).alias("timings"),
               F.struct(F.col("e").alias("mae"), ranking.alias("ranking")).alias("test_metrics"),
               F.struct(F.struct(F.struct((F.col("e") * 2).alias("mean")).alias("gpu_util_pct")).alias("train"))
               .alias("resources")).write.json(path)
    spark_rows = report.wide_runs(run_files.read_run_records(spark, path))
    return spark_rows.select("size_tag", "model", "n_workers", "mode", *[
        N.r6(F.col(f"`{c}`")).alias(c) for c in ("t_train", "ndcg@5", "ndcg@10", "precision@10", "mae", "gpu_util_mean")])
