"""Whole jobs: prepare, train from scratch, evaluate, recommend, update, tune, stream.

A model folder holds one subfolder per version (ids, vectors, interactions, replay) and
the held-out rows; each job reads and writes tables there and passes only scalars through
the driver.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import Config
from .functions import numeric as N, vectors as V
from .functions.hashing import xavier_bound
from .operators.versions import VersionLog
from .operators import (baselines, clean, content, encode, evaluate as E, graph, incremental as I, recommend as R, report,
                        split, training)
from .session import TemporaryTables, exists, materialize
from .sources import edges as edge_files, kafka, reviews as review_files, runs as run_files
from .streaming import articles, index


def read_dataset(spark: SparkSession, folder: str, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(businesses, users, reviews) of a folder with business, user and review CSVs or parquet."""
    names = [f"{folder}/{n}" for n in ("business", "user", "review")]
    b, u, r = review_files.load_tables(spark, *names, config.data.max_users, config.data.max_reviews)
    reviews = r.select("review_id", "user_id", F.col("business_id").alias("item_id"), "rating",
                       F.to_date(F.try_to_timestamp("date")).alias("date"))
    return review_files.catalogue(b).withColumnRenamed("business_id", "item_id"), u, reviews


class Phases:
    """Seconds of the phases of a job."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self._since = time.perf_counter()

    def done(self, name: str) -> None:
        now = time.perf_counter()
        self.seconds[name] = round(self.seconds.get(name, 0.0) + now - self._since, 3)
        self.seconds["t_total"] = round(sum(v for k, v in self.seconds.items() if k != "t_total"), 3)
        self._since = now


def _clean(spark: SparkSession, folder: str, config: Config) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, user ids, item ids, businesses) of a dataset, written once."""
    businesses, users, reviews = read_dataset(spark, folder, config)
    if config.data.domain_filter:
        businesses = clean.domain_filter(businesses)
    kept = clean.join_and_clean(reviews, businesses, config.data.rating_threshold)
    edges, user_ids, item_ids = encode.preprocess(kept, users, businesses, config.data.rating_threshold)
    return (materialize(edges, "edges"), materialize(user_ids, "users"), materialize(item_ids, "items"),
            businesses)


def _split(edges: DataFrame, config: Config) -> DataFrame:
    if config.data.temporal:
        return split.temporal_split(edges, ["user_idx", "item_idx"], config.data.ratios)
    return split.random_split(edges, ["user_idx", "item_idx"], config.data.split_seed, *config.data.ratios[1:])


def prepare(spark: SparkSession, folder: str, out: str, config: Config, size_tag: str = "full") -> DataFrame:
    """Filter the domain, join, clean, encode and split a dataset; write edges, ids, items and metadata.

    Edges are partitioned by their part of the split. Returns the metadata with the seconds of each
    phase.
    """
    clock = Phases()
    with TemporaryTables(spark):
        edges, user_ids, item_ids, businesses = _clean(spark, folder, config)
        clock.done("t_load")
        edge_files.write_table(_split(edges, config), f"{out}/edges", partition_by=("split",))
        clock.done("t_split")
        edge_files.write_table(user_ids, f"{out}/users")
        edge_files.write_table(item_ids, f"{out}/item_ids")
        edge_files.write_table(edge_files.item_catalogue(businesses, item_ids), f"{out}/items")
        clock.done("t_write")
        stored = spark.read.schema(edge_files.EDGE_SCHEMA).parquet(f"{out}/edges")
        edge_files.write_meta(edge_files.meta_row(stored, size_tag, clock.seconds), f"{out}/meta")
    return edge_files.read_meta(spark, f"{out}/meta")


STREAMS = ("pubmed", "arxiv", "unified", "index", "dead-letters")


def stream(spark: SparkSession, kind: str, records: DataFrame, out: str, once: bool = False):
    """Start one of the article streams over Kafka-shaped records; ``once`` takes what is there and stops."""
    data, checkpoint = f"{out}/data", f"{out}/checkpoint"
    if kind in ("pubmed", "arxiv"):
        topic = kafka.PUBMED_TOPIC if kind == "pubmed" else kafka.ARXIV_TOPIC
        return articles.topic_stream(records, topic, data, checkpoint, None if once else kafka.PER_TOPIC_TRIGGER)
    if kind == "unified":
        return articles.unified_stream(records, data, checkpoint, None if once else kafka.UNIFIED_TRIGGER)
    if kind == "index":
        enriched = articles.enrich_articles(articles.unified_articles(records))
        return index.index_stream(enriched, data, checkpoint, None if once else kafka.UNIFIED_TRIGGER)
    if kind == "dead-letters":
        return articles.dead_letter_stream(records, data, checkpoint, None if once else kafka.PER_TOPIC_TRIGGER)
    raise ValueError(f"unknown stream {kind!r}; one of {STREAMS}")


def record_version(spark: SparkSession, out: str, version: int, score: float, keep_last: int, restart: bool = False) -> DataFrame:
    """Record a version as one commit, delete the folders of those that no retained commit keeps, and return the
    versions kept with the reason. Raises ``Conflict`` if another writer has recorded the version."""
    return VersionLog(spark, out).record(version, score, keep_last, restart)


def _text_vectors(businesses: DataFrame, item_ids: DataFrame, config: Config) -> DataFrame:
    """(item, v): unit vectors of the items' category texts, brought to the model's dimension."""
    texts = businesses.join(item_ids, "item_id").select(F.col("item_idx").alias("item"), "categories")
    hashed = content.hashed_text_vectors(texts, "categories", config.graph.text_features)
    projected = graph.project(hashed.select("item", "v"), config.model.emb_dim, config.seed, config.graph.text_features)
    return projected.select("item", V.unit("v").alias("v"))


def _graph_rows(interactions: DataFrame, n_users: int, threshold: int, item_edges: DataFrame | None = None) -> DataFrame:
    links = interactions.select(F.col("user_idx").alias("user_id"),
                                (F.col("item_idx") + n_users).alias("item_id"), "rating")
    rows = graph.ui_edges(links, threshold).select("src", "dst")
    if item_edges is None:
        return rows
    return rows.unionByName(item_edges.select((F.col("src") + n_users).alias("src"), (F.col("dst") + n_users).alias("dst")))


def _final_vectors(state: I.ModelState, config: Config) -> DataFrame:
    n_users, n_items = state.users.count(), state.items.count()
    rows = _graph_rows(state.interactions, n_users, config.data.rating_threshold, state.item_edges)
    return graph.lightgcn(state.vectors, graph.both_directions(rows), config.model.emb_dim, config.model.n_layers,
                          n_nodes=n_users + n_items)


def _composite(metrics: DataFrame) -> float:
    row = metrics.orderBy("k").first()
    return 0.4 * row["NDCG"] + 0.3 * row["P"] + 0.3 * row["R"]


def _local(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_idx").alias("user"), F.col("item_idx").alias("item"), "rating")


def _trainer(config: Config, epochs: int, lr: float, warmup: int, min_epochs: int, eval_fn=None,
             item_edges: DataFrame | None = None):
    def run(vectors, interactions, pairs, n_users, n_items):
        if config.train.trainer == "als":
            trained = training.train_als(pairs, n_users, config.model.emb_dim, seed=config.seed)
            return graph.warm_start(vectors, trained)
        return training.train_bpr(
            vectors, pairs, _graph_rows(interactions, n_users, config.data.rating_threshold, item_edges), n_users, n_items,
            config.model.emb_dim, epochs, lr, warmup, config.train.n_neg, config.train.reg, config.model.n_layers,
            config.seed, eval_fn, min_epochs, config.train.eval_every, config.train.patience)[0]
    return run


def scratch(spark: SparkSession, folder: str, out: str, config: Config) -> DataFrame:
    """Train on a dataset, write version 1, the held-out rows and a manifest; return the test metrics.

    Items start from their category texts and the graph has item-item edges, where the settings say
    so. The metric file with the seconds of each phase goes to ``<out>/metrics``.
    """
    clock = Phases()
    with TemporaryTables(spark) as tables:
        edges, user_ids, item_ids, businesses = _clean(spark, folder, config)
        parts = materialize(_split(edges, config), "split", partition_by=["split"])
        n_users, n_items = user_ids.count(), item_ids.count()
        clock.done("t_load")
        nodes = user_ids.select(F.col("user_idx").alias("node")).unionByName(
            item_ids.select((F.col("item_idx") + n_users).alias("node")))
        start = graph.initial_vectors(nodes, config.model.emb_dim, n_users + n_items, config.seed)
        item_edges = None
        if config.graph.text_start or config.graph.item_item_edges:
            texts = materialize(_text_vectors(businesses, item_ids, config), "texts")
            if config.graph.text_start:
                # as long as the random start's components are wide
                bound = xavier_bound(config.model.emb_dim, n_users + n_items)
                start = graph.warm_start(start, texts.select((F.col("item") + n_users).alias("node"),
                                                             V.scale("v", F.lit(bound)).alias("v")))
            if config.graph.item_item_edges:
                near = graph.nearest_items(texts, config.graph.k_neighbors)
                item_edges = materialize(near.select(F.least("item", "neighbour").alias("src"),
                                                     F.greatest("item", "neighbour").alias("dst")).distinct(), "item_edges")
        start = materialize(start, "start")
        clock.done("t_graph")
        train = parts.filter("split = 'train'").select("user_idx", "item_idx", F.col("rating").cast("double").alias("rating"))
        empty = spark.createDataFrame([], "seq long, user_idx long, item_idx long, rating double")

        def validate(vectors: DataFrame) -> float:
            state = I.ModelState(user_ids, item_ids, vectors, train, empty, item_edges=item_edges)
            return _composite(_ranking(state, parts.filter("split = 'val'"), config, config.evaluation.k_list[:1]))

        t = config.train
        run = _trainer(config, t.epochs, t.lr, t.warmup_epochs, t.min_epochs, validate, item_edges)
        state = I.ModelState(user_ids, item_ids, run(start, train, train, n_users, n_items), train, empty, 1, item_edges)
        saved = I.ModelState.load(spark, state.save(out), 1)
        parts.filter("split = 'test'").write.mode("overwrite").parquet(f"{out}/test")
        businesses.write.mode("overwrite").parquet(f"{out}/catalogue")
        clock.done("t_train")
        test = spark.read.parquet(f"{out}/test")
        metrics = materialize(_ranking(saved, test, config, config.evaluation.k_list), "metrics")
        record_version(spark, out, 1, validate(saved.vectors), config.keep_last, restart=True)
        clock.done("t_eval")
        run_files.write_metrics(spark, f"{out}/metrics", "lightgcn_w1_v1", {}, {"ranking": metrics}, clock.seconds)
        rows = [tuple(r) for r in metrics.collect()]  # one row per K
    return spark.createDataFrame(rows, metrics.schema)


def _ranking(state: I.ModelState, held_out: DataFrame, config: Config, ks) -> DataFrame:
    test = _local(held_out)
    ev = config.evaluation
    users = E.eval_users(test, ev.relevant_from, ev.max_users).select("user")
    ranked = R.recommend(_final_vectors(state, config), state.users.count(), max(ks), users, _local(state.interactions))
    return E.ranking_metrics(ranked, test, ks, ev.relevant_from, max_users=ev.max_users)


def evaluate(spark: SparkSession, out: str, version: int, config: Config) -> dict[str, DataFrame]:
    """Metric tables of a version: ranking, K-filtered ranking, scores, baselines, normalised. Writes
    the version's metric file, too."""
    clock = Phases()
    state = I.ModelState.load(spark, f"{out}/v{version}", version)
    held = spark.read.parquet(f"{out}/test")
    test, ev = _local(held), config.evaluation
    n_users, n_items = state.users.count(), state.items.count()
    vectors = materialize(_final_vectors(state, config), "final")
    users = E.eval_users(test, ev.relevant_from).select("user")
    ranked = materialize(R.recommend(vectors, n_users, max(ev.k_list), users, _local(state.interactions)), "ranked")
    ranking = materialize(E.ranking_metrics(ranked, test, ev.k_list, ev.relevant_from, max_users=ev.max_users), "m")
    random = materialize(baselines.random_metrics(test, n_items, ev.k_list, ev.relevant_from, config.seed, ev.max_users), "m")
    nodes = test.select(F.col("user").alias("user_id"), (F.col("item") + n_users).alias("item_id"), "rating")
    out_tables = {
        "ranking": ranking, "random": random,
        "scores": E.evaluate_scores(nodes, vectors, n_users, n_items, ev.relevant_from),
        "popularity": baselines.popularity_metrics(_local(state.interactions), test, ev.k_list, ev.relevant_from, ev.max_users),
        "normalized": E.normalize_metrics(ranking, random, test, ev.k_list, ev.relevant_from),
    }
    if ev.k_filter:
        out_tables["ranking_kfiltered"] = E.ranking_metrics(ranked, test, ev.k_list, ev.relevant_from, True, ev.max_users)
    scores = out_tables["scores"] = materialize(out_tables["scores"], "m")
    clock.done("t_eval")
    run_files.write_metrics(spark, f"{out}/metrics", f"lightgcn_w1_v{version}", scores.first().asDict(),
                            {k: out_tables[k] for k in ("ranking", "ranking_kfiltered") if k in out_tables}, clock.seconds)
    return out_tables


def recommend(spark: SparkSession, out: str, version: int, config: Config, user_id: str, k: int = 10) -> DataFrame:
    """Top ``k`` of one known user with names and categories; empty for an unknown user."""
    state = I.ModelState.load(spark, f"{out}/v{version}", version)
    user = state.users.filter(F.col("user_id") == user_id).select(F.col("user_idx").alias("user"))
    recs = R.recommend(_final_vectors(state, config), state.users.count(), k, user, _local(state.interactions))
    return R.enrich(recs, state.items, spark.read.parquet(f"{out}/catalogue")).orderBy("rank")


def incremental(spark: SparkSession, out: str, version: int, batch: DataFrame, config: Config) -> I.ModelState:
    """Fold (review_id, user_id, item_id, rating, date) rows into a version and write the next one."""
    inc = config.incremental
    with TemporaryTables(spark):
        state = I.ModelState.load(spark, f"{out}/v{version}", version)
        run = _trainer(config, inc.epochs, config.train.lr * inc.lr_scale, inc.warmup_epochs, 0, item_edges=state.item_edges)
        new, _ = I.run_incremental(state, batch, config.model.emb_dim, ["date", "review_id"], run, config.data.rating_threshold,
                                   inc.new_data_only, inc.replay_ratio, inc.replay_capacity, config.seed)
        saved = I.ModelState.load(spark, new.save(out), new.version)
        if exists(spark, f"{out}/test"):
            held = _ranking(saved, spark.read.parquet(f"{out}/test"), config, config.evaluation.k_list[:1])
            record_version(spark, out, new.version, _composite(held), config.keep_last)
    return saved


def tune(spark: SparkSession, out: str, version: int, batch: DataFrame, config: Config,
         trials: int | None = None, alpha: float = 0.6) -> DataFrame:
    """Score the settings of the grid, or ``trials`` of them in a seeded order, on new and old data.

    Every trial is a Spark job of its own; rows of unknown items are left out of scoring
    and unknown users count as user 0.
    """
    state = I.ModelState.load(spark, f"{out}/v{version}", version)
    lenient = encode.lenient_encode(batch, state.users, state.items).select("user_idx", "item_idx", "rating")
    size = split.validation_size(state.interactions.count())
    old = split.sample_rows(state.interactions, ["user_idx", "item_idx"], size, config.seed)
    held = materialize(lenient.select("*", F.lit("new").alias("data")).unionByName(
        old.select("user_idx", "item_idx", "rating", F.lit("old").alias("data"))), "held")
    grid = report.trial_grid(spark)
    chosen = (grid if trials is None else split.sample_rows(grid, ["trial"], trials, config.seed)).collect()
    n_users, n_items = state.users.count(), state.items.count()
    metrics = None
    buffer = materialize(I.first_buffer(state.interactions, ["date", "review_id"], config.incremental.replay_capacity), "buffer")
    n_new = lenient.count()
    for row in chosen:
        run = _trainer(config, row["epochs"], config.train.lr * row["lr_scale"], config.incremental.warmup_epochs, 0)
        mix = I.mix_replay(lenient, buffer, n_new, row["replay_ratio"], config.seed)
        trained = run(state.vectors, state.interactions, mix, n_users, n_items)
        trial = I.ModelState(state.users, state.items, trained, state.interactions, state.replay)
        vectors = _final_vectors(trial, config)
        for data in ("new", "old"):
            test = _local(held.filter(F.col("data") == data)).withColumn("rating", F.lit(5.0))
            ranked = R.recommend(vectors, n_users, 10, test.select("user"))
            one = E.ranking_metrics(ranked, test, (10,)).select(
                F.lit(row["trial"]).cast("long").alias("trial"), F.lit(data).alias("data"), "NDCG", "P", "R")
            one = materialize(one, "trial")
            metrics = one if metrics is None else metrics.unionByName(one)
    return report.rank_trials(grid, metrics, alpha)


def grade_table(metrics: DataFrame) -> DataFrame:
    """Metrics with their quality grade."""
    return metrics.withColumn("grade", N.grade("NDCG"))

