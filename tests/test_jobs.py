import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan
from pomelo import cli, config, jobs
from pomelo.operators import incremental as I
from pomelo.operators.versions import VersionLog
from pomelo.sources import edges as edge_files, reviews as review_files, runs as run_files
from pomelo.streaming import index


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    """Two groups of users who like two groups of items."""
    folder = str(tmp_path_factory.mktemp("data"))
    rng = random.Random(4)
    rows = []
    for u in range(24):
        for i in rng.sample(range(10), 6):
            item = i + 10 * (u % 2)
            rows.append((f"r{u}-{item}", f"u{u:02d}", f"b{item:02d}", str(rng.choice((4, 5))), f"2020-01-{1 + len(rows) % 28:02d}"))
    b = spark.createDataFrame([(f"b{i:02d}", f"Place {i}", "Health, Group") for i in range(20)],
                              "business_id string, name string, categories string")
    u = spark.createDataFrame([(f"u{i:02d}", f"n{i}") for i in range(24)], "user_id string, name string")
    r = spark.createDataFrame(rows, "review_id string, user_id string, business_id string, stars string, date string")
    review_files.write_dataset(b, u, r, folder)
    return folder


def test_scratch_evaluate_recommend_update(spark, dataset, tmp_path):
    out = str(tmp_path / "model")
    cfg = config.load(None, {"model": {"emb_dim": 4}, "train": {"epochs": 2, "warmup_epochs": 1, "n_neg": 2, "lr": 0.2,
                                                               "min_epochs": 2, "eval_every": 2},
                             "incremental": {"epochs": 1, "warmup_epochs": 1}, "evaluation": {"k_list": [3, 5]}})
    metrics = jobs.scratch(spark, dataset, out, cfg)
    assert {r["k"] for r in metrics.collect()} == {3, 5}
    tables = jobs.evaluate(spark, out, 1, cfg)
    assert set(tables) == {"ranking", "random", "scores", "popularity", "normalized", "ranking_kfiltered"}
    assert tables["scores"].first()["rmse"] >= tables["scores"].first()["mae"]
    recs = jobs.recommend(spark, out, 1, cfg, "u03", 4).collect()
    assert [r["rank"] for r in recs] == [1, 2, 3, 4] and recs[0]["name"].startswith("Place")
    seen = {r["business_id"] for r in recs}
    kept = spark.read.parquet(f"{out}/v1/interactions")
    ids = spark.read.parquet(f"{out}/v1/users").filter("user_id = 'u03'").first()["user_idx"]
    items = {r["item_id"] for r in kept.filter(F.col("user_idx") == ids).join(spark.read.parquet(f"{out}/v1/items"), "item_idx").collect()}
    assert not seen & items
    assert jobs.recommend(spark, out, 1, cfg, "nobody", 4).count() == 0
    batch = spark.createDataFrame([("x1", "new", "b01", 5, "2020-02-01"), ("x2", "u03", "fresh", 4, "2020-02-03"), ("x3", "u03", "fresh", 5, "2020-02-02")],
                                  "review_id string, user_id string, item_id string, rating int, date string")
    state = jobs.incremental(spark, out, 1, batch, cfg)
    assert state.version == 2 and state.users.count() == 25 and state.items.count() == 21
    fresh = state.items.filter("item_id = 'fresh'").first()["item_idx"]
    assert state.interactions.filter(F.col("item_idx") == fresh).first()["rating"] == 4.0  # the newest by date
    ranked = jobs.tune(spark, out, 1, batch, cfg, trials=1)
    assert ranked.count() == 1 and 0 <= ranked.first()["score"] <= 1


def test_als_trainer(spark, dataset, tmp_path):
    cfg = config.load(None, {"model": {"emb_dim": 4}, "train": {"trainer": "als"}, "evaluation": {"k_list": [5]}})
    row = jobs.scratch(spark, dataset, str(tmp_path / "m"), cfg).first()
    assert row["HR"] > 0


def test_settings_precedence(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("train:\n  lr: 0.5\n  epochs: 7\nevaluation:\n  k_list: [1, 2]\n")
    args = cli.parser().parse_args(["scratch", "--model-dir", "m", "--epochs", "9", "--max-reviews", "5"])
    cfg = config.load(str(path), cli.overrides(args))
    assert (cfg.train.lr, cfg.train.epochs, cfg.evaluation.k_list, cfg.data.max_reviews) == (0.5, 9, (1, 2), 5)
    assert config.load().train.epochs == 200
    with pytest.raises(ValueError, match="unknown setting"):
        config.load(None, {"train": {"speed": 1}})


def test_prepare_mode(spark, dataset, tmp_path):
    out = str(tmp_path / "prepared")
    cli.main(["prepare", "--data-dir", dataset, "--model-dir", out, "--size-tag", "1k"])
    meta = edge_files.read_meta(spark, f"{out}/meta").first()
    edges, items, _ = edge_files.load_prepared(spark, out)
    assert meta["size_tag"] == "1k" and meta["n_edges"] == edges.count() == 144 and meta["n_items"] == items.count()
    assert set(meta["timings"]) == {"t_load", "t_split", "t_write", "t_total"} and sum(meta["split_counts"].values()) == 144
    train = edges.filter("split = 'train'")
    assert "PartitionFilters: [isnotnull(split" in plan(train) and train.count() == meta["split_counts"]["train"]


def test_version_manifest_and_metric_file(spark, dataset, tmp_path):
    out = str(tmp_path / "model")
    cfg = {"keep_last": 1, "graph": {"item_item_edges": True, "k_neighbors": 2, "text_features": 16},
           "model": {"emb_dim": 4}, "train": {"epochs": 1, "n_neg": 2}, "evaluation": {"k_list": [3]},
           "incremental": {"epochs": 1, "warmup_epochs": 1}}
    jobs.scratch(spark, dataset, out, config.load(None, cfg))
    state = I.ModelState.load(spark, f"{out}/v1", 1)
    assert state.item_edges.count() > 0
    flat = run_files.flatten_ranking(run_files.read_metrics(spark, f"{out}/metrics/*")).first()
    assert (flat["model"], flat["size_tag"], flat["k"]) == ("lightgcn", "v1", 3)
    batch = spark.createDataFrame([("x1", "new", "b01", 5, "2020-02-01")],
                                  "review_id string, user_id string, item_id string, rating int, date string")
    jobs.incremental(spark, out, 1, batch, config.load(None, cfg))
    assert {r["version"] for r in VersionLog(spark, out).table().collect()} == {1, 2}
    kept = {r["version"] for r in jobs.record_version(spark, out, 3, 2.0, 1).collect()}
    assert kept == {3}  # the newest is the best, too
    assert not os.path.exists(f"{out}/v1") and not os.path.exists(f"{out}/v2")


@pytest.mark.parametrize("kind", jobs.STREAMS)
def test_stream_mode(spark, tmp_path, kind):
    body = '{"source": "pubmed", "pmid": "1", "title": "On care", "abstract": "a", "ingested_at": "2024-01-01T00:00:00"}'
    rows = [("pubmed-articles", 0, 0, body), ("arxiv-articles", 0, 1, body.replace("pubmed", "arxiv").replace("pmid", "arxiv_id")),
            ("pubmed-articles", 0, 2, "{broken")]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, value string").selectExpr(
        "topic", "partition", "offset", "timestamp'2024-01-02 00:00:00' AS timestamp", "CAST(value AS BINARY) AS value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    cli.main(["stream", "--model-dir", out, "--stream", kind, "--records-dir", str(tmp_path / "in"), "--once"])
    stored = index.read_index(spark, f"{out}/data") if kind == "index" else spark.read.parquet(f"{out}/data")
    assert stored.count() == {"pubmed": 1, "arxiv": 1, "unified": 3, "index": 2, "dead-letters": 1}[kind]
