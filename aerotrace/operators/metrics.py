"""Benchmark metric tables: scene means, summary pivots and run comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of metrics where less is better.
LOWER_IS_BETTER = ("comp", "acc", "overall", "error", "loss", "rmse", "mae")


def lower_is_better(metric: str = "metric") -> Column:
    return F.lower(F.col(metric)).rlike("|".join(LOWER_IS_BETTER))


def with_mean(metrics: DataFrame, by: Sequence[str] = ("dataset", "mode", "metric")) -> DataFrame:
    """Scene rows plus one ``mean`` row per dataset, mode and metric; failed scenes are absent."""
    rows = metrics.select(*by, "scene", "value").filter(F.col("value").isNotNull())
    mean = rows.groupBy(*by).agg(F.lit("mean").alias("scene"), F.avg("value").alias("value"))
    return rows.unionByName(mean)


def flag_best(df: DataFrame, by: Sequence[str], value: str = "value", metric: str = "metric") -> DataFrame:
    """Mark best and worst values of a row of a table with at least two values (ties share)."""
    w = Window.partitionBy(*by)
    lo, hi, n = F.min(value).over(w), F.max(value).over(w), F.count(value).over(w)
    low = lower_is_better(metric)
    best, worst = F.when(low, lo).otherwise(hi), F.when(low, hi).otherwise(lo)
    near = lambda x: F.abs(F.col(value) - x) < 1e-8
    return df.withColumns({"is_best": F.coalesce((n > 1) & near(best), F.lit(False)), "is_worst": F.coalesce((n > 1) & near(worst), F.lit(False))})


def summary_pivot(metrics: DataFrame, datasets: Sequence[str], mode: str, metric_order: Sequence[str], leave_out: Sequence[str] = ()) -> DataFrame:
    """One row per metric, one column per dataset in fixed order, and the average over datasets.

    Datasets in ``leave_out`` are shown but do not enter the average.
    """
    mean = metrics.filter((F.col("mode") == mode) & F.col("metric").isin(*metric_order) & F.col("dataset").isin(*datasets))
    mean = mean.groupBy("metric", "dataset").agg(F.avg("value").alias("v"))
    avg = F.avg(F.when(~F.col("dataset").isin(*leave_out), F.col("v"))) if leave_out else F.avg("v")
    cells = [F.max(F.when(F.col("dataset") == d, F.col("v"))).alias(d) for d in datasets]
    d = mean.groupBy("metric").agg(avg.alias("avg"), *cells)
    rank = F.array_position(F.array(*[F.lit(m) for m in metric_order]), F.col("metric"))
    return d.withColumn("row", rank)


def compare_runs(metrics: DataFrame, runs: Sequence[str], by: Sequence[str] = ("dataset", "mode", "metric")) -> DataFrame:
    """Mean per run side by side, absent runs NULL, with the best and worst run of each row."""
    mean = metrics.groupBy(*by, "run").agg(F.avg("value").alias("value"))
    g = mean.groupBy(*by).agg(*[F.max(F.when(F.col("run") == x, F.col("value"))).alias(x) for x in runs])
    vals = [F.col(x) for x in runs]
    present = sum((v.isNotNull().cast("int") for v in vals[1:]), vals[0].isNotNull().cast("int"))
    lo, hi = F.least(*vals), F.greatest(*vals)
    low = lower_is_better("metric")
    best, worst = F.when(low, lo).otherwise(hi), F.when(low, hi).otherwise(lo)
    # the first run wins an exact tie
    name = lambda target: F.when(present > 1, F.coalesce(*[F.when(F.abs(F.col(x) - target) < 1e-8, F.lit(x)) for x in runs]))
    return g.withColumns({"best_run": name(best), "worst_run": name(worst)})
