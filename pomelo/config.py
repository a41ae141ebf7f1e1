"""Settings of the jobs: command line over YAML file over defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass


# The defaults of every job.
@dataclass
class Data:
    ratios: tuple[float, float, float] = (0.70, 0.15, 0.15)
    rating_threshold: int = 3
    split_seed: int = 1
    temporal: bool = False
    domain_filter: bool = True
    max_users: int = 0
    max_reviews: int = 0


@dataclass
class Graph:
    k_neighbors: int = 5
    item_item_edges: bool = False
    text_start: bool = True
    text_features: int = 768


@dataclass
class Model:
    emb_dim: int = 64
    n_layers: int = 1


@dataclass
class Train:
    trainer: str = "bpr"
    epochs: int = 200
    lr: float = 0.005
    warmup_epochs: int = 10
    n_neg: int = 10
    reg: float = 1e-5
    min_epochs: int = 80
    patience: int = 15
    eval_every: int = 10


@dataclass
class Evaluation:
    k_list: tuple[int, ...] = (5, 10, 20)
    max_users: int | None = None
    relevant_from: float = 3.0
    k_filter: bool = True


@dataclass
class Incremental:
    epochs: int = 20
    lr_scale: float = 0.1
    warmup_epochs: int = 2
    replay_ratio: float = 0.3
    replay_capacity: int | None = None
    new_data_only: bool = False


@dataclass
class Config:
    seed: int = 42
    keep_last: int = 3
    data: Data = field(default_factory=Data)
    graph: Graph = field(default_factory=Graph)
    model: Model = field(default_factory=Model)
    train: Train = field(default_factory=Train)
    evaluation: Evaluation = field(default_factory=Evaluation)
    incremental: Incremental = field(default_factory=Incremental)


def merge(config, values: dict):
    """Overwrite the named fields, section by section; unknown names are an error."""
    known = {f.name for f in fields(config)}
    for name, value in values.items():
        if name not in known:
            raise ValueError(f"unknown setting {name!r}; one of {sorted(known)}")
        current = getattr(config, name)
        if is_dataclass(current):
            merge(current, value or {})
        elif isinstance(current, tuple):
            setattr(config, name, tuple(value))
        else:
            setattr(config, name, value if current is None else type(current)(value))
    return config


def load(path: str | None = None, overrides: dict | None = None) -> Config:
    config = Config()
    if path:
        import yaml
        with open(path) as handle:
            merge(config, yaml.safe_load(handle) or {})
    return merge(config, overrides or {})
