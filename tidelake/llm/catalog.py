"""Queries of this subpackage: ``op1_`` to ``op13_`` and the pipeline."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries; each has QUERIES and ORACLES.
MODULES = ("queries",)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__package__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__package__}.{name}").ORACLES
    return found
