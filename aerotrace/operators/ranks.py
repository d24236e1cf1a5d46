"""Exact order statistics of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerotrace.operators.runtime import cut

# Distinct values a single percentile buffer may hold, and bins per refinement pass.
DIRECT_ROWS = 1_000_000
BINS = 4096


def exact_percentile(df: DataFrame, by: Sequence[str], col: str, ps: dict[str, float], direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Linearly interpolated percentiles per group; ``ps`` maps output names to fractions.

    Groups of up to ``direct_rows`` values use the built-in aggregate. In larger ones each wanted
    rank is located by counting values in equal-width bins, the bin that holds it is cut into
    bins again until it is small or holds one value, and only that last bin is sorted, by distinct value with its count. No task ever
    holds a whole group.
    """
    by = list(by)
    if not by:
        one = exact_percentile(df.withColumn("__all", F.lit(0)), ["__all"], col, ps, direct_rows)
        return one.drop("__all")
    d = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).select(*by, F.col(col).cast("double").alias("__v"))
    size = d.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    tagged = d.join(size, by)
    small = (tagged.filter(F.col("__n") <= direct_rows).groupBy(*by)
             .agg(*[F.percentile("__v", p).alias(o) for o, p in ps.items()]))
    if size.filter(F.col("__n") > direct_rows).isEmpty():
        return d.groupBy(*by).agg(*[F.percentile("__v", p).alias(o) for o, p in ps.items()])
    big = tagged.filter(F.col("__n") > direct_rows)
    # two neighbouring ranks per percentile, counted from zero
    wanted = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(float(p)).alias("p")) for o, p in ps.items()])
    ranks = size.filter(F.col("__n") > direct_rows).withColumn("__w", F.explode(wanted)).select(
        *by, F.col("__w.o").alias("__o"), (F.col("__w.p") * (F.col("__n") - 1)).alias("__pos"), "__lo", "__hi")
    ranks = ranks.withColumn("__k", F.explode(F.array_distinct(F.array(F.floor("__pos"), F.ceil("__pos"))))).withColumn("__below", F.lit(0).cast("bigint"))
    keys = [*by, "__o", "__k"]
    pool = big.select(*by, "__v").join(ranks.select(*keys, "__lo", "__hi"), by)
    while True:
        width = (F.col("__hi") - F.col("__lo")) / BINS
        pool = pool.withColumn("__bin", F.when(width > 0, F.least(F.floor((F.col("__v") - F.col("__lo")) / width), F.lit(BINS - 1))).otherwise(0))
        hist = pool.groupBy(*keys, "__bin").agg(F.count("*").alias("__c"), F.min("__v").alias("__blo"), F.max("__v").alias("__bhi"))
        w = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("__b", F.coalesce(F.sum("__c").over(w), F.lit(0)))
        hit = hist.join(ranks.select(*keys, "__below", "__pos"), keys)
        inside = (F.col("__k") >= F.col("__below") + F.col("__b")) & (F.col("__k") < F.col("__below") + F.col("__b") + F.col("__c"))
        hit = cut(hit.filter(inside))
        ranks = hit.select(*keys, "__pos", F.col("__blo").alias("__lo"), F.col("__bhi").alias("__hi"), (F.col("__below") + F.col("__b")).alias("__below"))
        pool = (pool.join(hit.select(*keys, "__bin", F.col("__blo").alias("__l2"), F.col("__bhi").alias("__h2")), [*keys, "__bin"])
                .select(*keys, "__v", F.col("__l2").alias("__lo"), F.col("__h2").alias("__hi")))
        if hit.filter((F.col("__c") > direct_rows) & (F.col("__blo") < F.col("__bhi"))).isEmpty():
            break
    vals = pool.groupBy(*keys, "__v").agg(F.count("*").alias("__c")).join(ranks.select(*keys, "__below", "__pos"), keys)
    w = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    vals = vals.withColumn("__end", F.col("__below") + F.sum("__c").over(w)).filter(
        (F.col("__k") < F.col("__end")) & (F.col("__k") >= F.col("__end") - F.col("__c")))
    pair = vals.groupBy(*by, "__o", "__pos").agg(F.min_by("__v", "__k").alias("__a"), F.max_by("__v", "__k").alias("__z"))
    pair = pair.withColumn("__r", F.col("__a") + (F.col("__z") - F.col("__a")) * (F.col("__pos") - F.floor("__pos")))
    large = pair.groupBy(*by).agg(*[F.max(F.when(F.col("__o") == o, F.col("__r"))).alias(o) for o in ps])
    return small.unionByName(large)
