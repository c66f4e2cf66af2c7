"""The queries that ``__spark_entry__`` lists, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almucantar.session import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Coordinates that testdata keys stand for, the same in both engines.
LAT, LON = "(({k} * 7919) % 12000) / 100.0D - 60.0D", "(({k} * 104729) % 36000) / 100.0D - 180.0D"
SQL_LAT, SQL_LON = "CAST(({k} * 7919) % 12000 AS DOUBLE) / 100.0 - 60.0", "CAST(({k} * 104729) % 36000 AS DOUBLE) / 100.0 - 180.0"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def points(spark: SparkSession, sf_dir: str, name: str = "customer", key: str = "c_custkey") -> DataFrame:
    """Places that the rows of a table stand for: place, lat, lon."""
    k = f"cast({key} as bigint)"
    return table(spark, sf_dir, name).select(F.col(key).cast("long").alias("place"), F.expr(LAT.format(k=k)).alias("lat"), F.expr(LON.format(k=k)).alias("lon"))


def sql_points(name: str = "customer", key: str = "c_custkey") -> str:
    """The same places in SQL."""
    return f"SELECT CAST({key} AS BIGINT) AS place, {SQL_LAT.format(k=key)} AS lat, {SQL_LON.format(k=key)} AS lon FROM {name}"


def micro(column: str, digits: int = 6):
    """A value in fixed point, so that last bits of different mathematics libraries do not matter."""
    return F.round(F.col(column) * float(10**digits)).cast("long")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: typical values at times and places from the climatology."""
    return queries()["clim_blend"](spark, sf_dir)


def queries() -> dict[str, Query]:
    """All registered queries by name."""
    from almucantar.plans import answers, batch, ground, serving, sky, units, upkeep  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    queries()
    return dict(_SQL)
