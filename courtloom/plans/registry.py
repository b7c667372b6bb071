"""Query registry: each entry pairs a Spark plan with an independent SQL statement of the same result.

`cols` names the output columns; a suffix gives the type both engines cast to:
none = BIGINT, `:s` = string, `:k` = double scaled by 1000 and rounded to BIGINT, `:h` = scaled by 10.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtloom.plans.adapters import with_ctes
from courtloom.session import ship_package

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}
_SCALE = {"k": "1e3", "h": "1e1"}


def _casts(cols: str, text: str) -> list[str]:
    out = []
    for item in cols.split():
        name, _, kind = item.partition(":")
        if kind == "s":
            out.append(f"cast({name} as {text}) as {name}")
        elif kind in _SCALE:
            out.append(f"cast(floor({name} * {_SCALE[kind]} + 5e-1) as bigint) as {name}")
        else:
            out.append(f"cast({name} as bigint) as {name}")
    return out


def query(name: str, cols: str, ctes: str = "", sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(ship_package(spark), sf_dir).selectExpr(*_casts(cols, "string"))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"select {', '.join(_casts(cols, 'varchar'))} from ({with_ctes(ctes, sql)}) as q"
        return plan

    return register
