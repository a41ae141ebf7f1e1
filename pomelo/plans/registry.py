"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    covers: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists the operator ids of the survey."""
    def wrap(run: Runner) -> Runner:
        if name in REGISTRY:
            raise ValueError(f"{name} registered twice")
        REGISTRY[name] = Query(name, run, tuple(covers.split()), sql)
        return run
    return wrap
