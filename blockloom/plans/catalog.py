"""Registry of the engine's queries: name -> (DataFrame builder, DuckDB twin)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, builder: Builder, oracle: str | None = None) -> None:
    QUERIES[name] = builder
    if oracle is not None:
        ORACLES[name] = oracle
