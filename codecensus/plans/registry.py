"""Registry of driver queries (Spark side) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function, optionally with oracle SQL."""
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that its queries are registered."""
    from . import q_structure, q_manifests, q_routes, q_infra, q_modules, q_diff, q_snapshot, q_reports, q_sources, q_documents, q_document_set  # noqa: F401
