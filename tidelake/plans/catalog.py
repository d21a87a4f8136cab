"""Registered queries of the reference operators, each with the DuckDB SQL it is compared with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Modules that register queries.
MODULES = ("q_rollups", "q_scalars", "q_rules", "q_windows", "q_sources", "q_stores", "q_events", "q_alerts", "q_lake", "q_health")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)


def query(name: str, oracle: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function as query ``name``."""

    def put(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
