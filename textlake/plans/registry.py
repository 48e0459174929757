"""Registry of named queries: a Spark builder plus (optionally) oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    group: str


REGISTRY: dict[str, Query] = {}


def register(name: str, group: str, sql: str | None = None):
    """Decorator: ``@register("rating_counts", "agg", sql=...)``."""

    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        REGISTRY[name] = Query(name, fn, sql, group)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills the registry
    from textlake.plans import (  # noqa: F401
        q_clean, q_join, q_scalar, q_agg, q_sample, q_text, q_score, q_ml, q_stream, q_io,
    )
    return REGISTRY
