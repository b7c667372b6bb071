"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib
import pkgutil

from courtloom import plans
from courtloom.plans.registry import ORACLES, QUERIES


def _load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_")):
        importlib.import_module(f"courtloom.plans.{module}")


def queries() -> dict:
    _load()
    return dict(sorted(QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(sorted(ORACLES.items()))
