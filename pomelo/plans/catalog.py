"""All registered queries."""

from . import ingest, models, prepare, reports, tables, updates  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
