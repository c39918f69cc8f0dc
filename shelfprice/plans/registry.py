"""Names, Spark plans and check SQL of the registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
MODULES = ("intake", "series", "reports", "pricing", "deals", "learning", "linear")


class Query(NamedTuple):
    plan: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function name, with its check SQL if there is one."""

    def add(plan: Plan) -> Plan:
        if plan.__name__ in QUERIES:
            raise ValueError(f"query {plan.__name__} is registered twice")
        QUERIES[plan.__name__] = Query(plan, sql)
        return plan

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"shelfprice.plans.{name}")


def queries() -> dict[str, Plan]:
    _load()
    return {name: q.plan for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: q.sql for name, q in QUERIES.items() if q.sql is not None}
