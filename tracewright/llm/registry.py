"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MODULES = sorted(p.stem for p in Path(__file__).parent.glob("op*_*.py"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for name in MODULES:
        module = importlib.import_module(f"{__package__}.{name}")
        found[name] = getattr(module, name)
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        sql = getattr(importlib.import_module(f"{__package__}.{name}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
