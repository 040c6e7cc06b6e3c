"""Named queries over the driver tables and the SQL they are checked against."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("matrix", "sequence", "fragment", "model")
_HELPERS = {"valid", "scored", "sequences_of"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for name in _MODULES:
        module = import_module(f"fragweave.plans.queries_{name}")
        for key, fn in vars(module).items():
            own = inspect.isfunction(fn) and fn.__module__ == module.__name__
            if own and not key.startswith("_") and key not in _HELPERS:
                out[key] = fn
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in _MODULES:
        out |= import_module(f"fragweave.plans.oracle_{name}").ORACLE
    return out
