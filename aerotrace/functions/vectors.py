"""Vectors held in array columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    pair = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pair, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2norm(a, floor: float = 1e-8) -> Column:
    """Unit vector; NULL when the length is below ``floor``."""
    n = norm(a)
    return F.when(n >= floor, F.transform(_c(a), lambda x: x.cast("double") / n))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def by_element(df: DataFrame, by: Sequence[str], col: str, agg: Callable[[Column], Column], out: str) -> DataFrame:
    """Element-wise aggregate of an array column of any length, one row per group.

    Each element is its own partial aggregate, so a group of any size reduces before the shuffle. A group
    without elements has NULL.
    """
    by = list(by)
    e = df.select(*by, F.posexplode_outer(col).alias("__i", "__x")).groupBy(*by, "__i").agg(agg(F.col("__x").cast("double")).alias("__v"))
    items = F.array_sort(F.collect_list(F.when(F.col("__i").isNotNull(), F.struct("__i", "__v"))))
    return e.groupBy(*by).agg(items.alias("__a")).select(*by, F.when(F.size("__a") > 0, F.transform("__a", lambda x: x["__v"])).alias(out))
