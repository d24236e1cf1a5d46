"""Connected components of links between 64-bit keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerotrace.llm.common import keep


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every key in ``links`` (a, b): the smallest key that links reach.

    Large-star and small-star steps take turns until the links no longer change; each turn ends in a written table. What a
    step joins is written out first, so that the engine can split the many links of one key among tasks.
    """
    e = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    now = _state(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = keep(large)
        least = keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, now = now, _state(e)
        if before == now:
            break
    return e.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct())
