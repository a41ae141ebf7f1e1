"""Command line: ``python -m pomelo.cli MODE --model-dir DIR ...``."""

from __future__ import annotations

import argparse

from . import config as settings, jobs
from .session import build_session
from .sources import kafka

MODES = ("prepare", "scratch", "evaluate", "incremental", "tune", "recommend", "stream")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pomelo")
    p.add_argument("mode", choices=MODES)
    p.add_argument("--model-dir", required=True, help="folder of the model versions, or of the prepared data or stream")
    p.add_argument("--data-dir", help="folder with business, user and review CSVs (scratch) or new reviews")
    p.add_argument("--config", help="YAML file")
    p.add_argument("--size-tag", default="full", help="name of the prepared dataset")
    p.add_argument("--stream", choices=jobs.STREAMS, default="unified")
    p.add_argument("--servers", help="Kafka servers of a stream")
    p.add_argument("--records-dir", help="parquet files of records in place of Kafka")
    p.add_argument("--once", action="store_true", help="take what a stream has and stop")
    p.add_argument("--version", type=int, default=1)
    p.add_argument("--user-id")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--trials", type=int, help="settings to try; all by default")
    p.add_argument("--epochs", type=int)
    p.add_argument("--lr", type=float)
    p.add_argument("--emb-dim", type=int)
    p.add_argument("--trainer", choices=("bpr", "als"))
    p.add_argument("--max-users", type=int)
    p.add_argument("--max-reviews", type=int)
    p.add_argument("--rating-threshold", type=int)
    p.add_argument("--replay-ratio", type=float)
    p.add_argument("--new-data-only", action="store_true", default=None)
    p.add_argument("--seed", type=int)
    p.add_argument("--master")
    return p


def overrides(args: argparse.Namespace) -> dict:
    """Settings given on the command line, by section."""
    epochs = "incremental" if args.mode == "incremental" else "train"
    given = {
        "seed": args.seed, "model.emb_dim": args.emb_dim, f"{epochs}.epochs": args.epochs, "train.lr": args.lr,
        "train.trainer": args.trainer, "data.max_users": args.max_users, "data.max_reviews": args.max_reviews,
        "data.rating_threshold": args.rating_threshold, "incremental.replay_ratio": args.replay_ratio,
        "incremental.new_data_only": args.new_data_only,
    }
    out: dict = {}
    for name, value in given.items():
        if value is None:
            continue
        section, _, key = name.rpartition(".")
        (out.setdefault(section, {}) if section else out)[key] = value
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    cfg = settings.load(args.config, overrides(args))
    spark = build_session(f"pomelo-{args.mode}", args.master)
    if args.mode == "prepare":
        jobs.prepare(spark, args.data_dir, args.model_dir, cfg, args.size_tag).show(truncate=False)
    elif args.mode == "stream":
        records = (kafka.read_files(spark, args.records_dir) if args.records_dir
                   else kafka.read_kafka(spark, args.servers))
        jobs.stream(spark, args.stream, records, args.model_dir, args.once).awaitTermination()
    elif args.mode == "scratch":
        jobs.grade_table(jobs.scratch(spark, args.data_dir, args.model_dir, cfg)).show(truncate=False)
    elif args.mode == "evaluate":
        for name, table in jobs.evaluate(spark, args.model_dir, args.version, cfg).items():
            print(name)
            table.show(50, truncate=False)
    elif args.mode == "recommend":
        jobs.recommend(spark, args.model_dir, args.version, cfg, args.user_id, args.top_k).show(args.top_k, False)
    else:
        _, _, batch = jobs.read_dataset(spark, args.data_dir, cfg)
        if args.mode == "incremental":
            state = jobs.incremental(spark, args.model_dir, args.version, batch, cfg)
            print(f"version {state.version}: {state.users.count()} users, {state.items.count()} items")
        else:
            jobs.tune(spark, args.model_dir, args.version, batch, cfg, args.trials).show(args.trials or 100, False)


if __name__ == "__main__":
    main()
