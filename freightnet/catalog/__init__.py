"""Every operator as a query over the given tables, next to independent SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightnet.sources.adapter import Tables


@dataclass(frozen=True)
class Query:
    covers: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists the inventory ids it shows."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(covers, build, sql)
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, so that both engines hand over the same values."""
    cols = []
    for f in df.schema:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind == "decimal":
            c = c.cast("double")
        elif kind == "date":
            c = c.cast("string")
        elif kind == "array":
            c = F.concat_ws(",", c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load() -> dict[str, Query]:
    from freightnet.catalog import costing, decisions, demanding, historic, plans, shaping  # noqa: F401

    return REGISTRY


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: plain(q.build(Tables(spark, folder)))

    return {name: runner(q) for name, q in load().items()}


def oracles() -> dict[str, str]:
    return {name: q.sql for name, q in load().items() if q.sql is not None}
