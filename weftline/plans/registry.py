"""The registered queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES: tuple[str, ...] = ("graphs", "sequences", "trees", "topologies", "mixtures", "families", "factors", "forests", "ranges", "fields", "comparisons", "models")


def _all() -> dict[str, tuple[Callable, str | None]]:
    out: dict[str, tuple[Callable, str | None]] = {}
    for module in MODULES:
        out |= importlib.import_module(f"weftline.plans.{module}").QUERIES
    return out


def queries() -> dict[str, Callable]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
