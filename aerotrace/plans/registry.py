"""Registry of named queries and of the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerotrace.plans.views import Tables, with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(tables)`` as a query; ``views`` names the fixture views its SQL reads."""
    def add(fn):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(name, fn, with_views(views.split(), sql) if sql else None)
        return fn
    return add


def r(col, digits: int = 6) -> Column:
    """Rounded double for comparison across engines."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rs(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL text; adding zero turns -0.0 into 0.0."""
    return f"(round(CAST(({expr}) AS DOUBLE), {digits}) + 0.0)"


def hav(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = 6371000.0) -> str:
    """Great-circle distance in SQL text."""
    return (f"(2.0*{radius}*asin(sqrt(pow(sin((radians({lat2})-radians({lat1}))/2),2)"
            f"+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians(({lon2})-({lon1}))/2),2))))")
