"""Ordered scans over long missions without one task per mission.

A window partitioned by mission alone puts a whole mission in one task. Here each mission is
cut into segments (a time or frame range of bounded length), the window runs per segment, and
one summary row per segment carries the state across segments. Summaries are scanned in two
levels, so no window ever holds more than a segment, 1024 summaries, or 1/1024 of the summaries.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from aerotrace.operators.runtime import cut

SUMMARY_FAN = 1024


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(o) for o in order])


def _carry_summary(s: DataFrame, by: list[str], vals: dict[str, tuple[str, bool]]) -> DataFrame:
    """Per segment, the last non-null value of earlier segments (or the first of later ones).

    ``vals`` maps a summary column to its output name and direction (True looks back).
    """
    s = s.withColumn("__sup", F.floor(F.col("__seg") / SUMMARY_FAN))

    def reach(part, key, col, back):
        w = Window.partitionBy(*part).orderBy(F.col(key).asc() if back else F.col(key).desc())
        return F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))

    s = s.withColumns({f"__1{v}": reach([*by, "__sup"], "__seg", v, back) for v, (_, back) in vals.items()})
    upper = s.groupBy(*by, "__sup").agg(*[
        (F.max_by if back else F.min_by)(v, F.when(F.col(v).isNotNull(), F.col("__seg"))).alias(f"__2{v}")
        for v, (_, back) in vals.items()])
    upper = upper.withColumns({f"__2{v}": reach(by, "__sup", f"__2{v}", back) for v, (_, back) in vals.items()})
    return (s.join(upper, [*by, "__sup"], "left")
            .select(*by, "__seg", *[F.coalesce(f"__1{v}", f"__2{v}").alias(o) for v, (o, _) in vals.items()]))


def carry(df: DataFrame, by: Sequence[str], order: Sequence[str], segment: Column, value: Column,
          prev: str | None = None, next: str | None = None,
          prev_inclusive: bool = True, next_inclusive: bool = False) -> DataFrame:
    """Add the nearest non-null ``value`` looking back (``prev``) and/or ahead (``next``).

    ``order`` must be total within ``by``; ``segment`` must not decrease along it.
    """
    by, order = list(by), list(order)
    d = df.withColumn("__seg", segment.cast("bigint")).withColumn("__val", value)
    keys = [*by, "__seg"]
    ordv = F.when(F.col("__val").isNotNull(), _order_struct(order))
    # looking ahead runs over the reversed order: frames that only shrink cost quadratic time
    w = Window.partitionBy(*keys).orderBy(*order)
    rev = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    aggs, vals = [], {}
    if prev:
        d = d.withColumn("__lp", F.last("__val", ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0 if prev_inclusive else -1)))
        aggs.append(F.max_by("__val", ordv).alias("__sp"))
        vals["__sp"] = ("__cp", True)
    if next:
        d = d.withColumn("__ln", F.last("__val", ignorenulls=True).over(
            rev.rowsBetween(Window.unboundedPreceding, 0 if next_inclusive else -1)))
        aggs.append(F.min_by("__val", ordv).alias("__sn"))
        vals["__sn"] = ("__cn", False)
    d = d.join(_carry_summary(d.groupBy(*keys).agg(*aggs), by, vals), keys, "left")
    if prev:
        d = d.withColumn(prev, F.coalesce("__lp", "__cp"))
    if next:
        d = d.withColumn(next, F.coalesce("__ln", "__cn"))
    return d.drop("__seg", "__val", "__lp", "__ln", "__cp", "__cn")


def previous(df, by, order, segment, cols: Sequence[str], out: str) -> DataFrame:
    """Struct of ``cols`` from the row just before."""
    return carry(df, by, order, segment, F.struct(*cols), prev=out, prev_inclusive=False)


def following(df, by, order, segment, cols: Sequence[str], out: str) -> DataFrame:
    """Struct of ``cols`` from the row just after."""
    return carry(df, by, order, segment, F.struct(*cols), next=out)


def _prefix(totals: DataFrame, by: list[str], val: str, out: str, suffix: bool = False) -> DataFrame:
    """Sum of ``val`` over the earlier (or later) segments."""
    t = totals.withColumn("__sup", F.floor(F.col("__seg") / SUMMARY_FAN))
    up = lambda c: F.col(c).desc() if suffix else F.col(c).asc()
    t = t.withColumn("__p1", F.sum(val).over(
        Window.partitionBy(*by, "__sup").orderBy(up("__seg")).rowsBetween(Window.unboundedPreceding, -1)))
    upper = t.groupBy(*by, "__sup").agg(F.sum(val).alias("__st"))
    upper = upper.withColumn("__p2", F.sum("__st").over(
        Window.partitionBy(*by).orderBy(up("__sup")).rowsBetween(Window.unboundedPreceding, -1))).drop("__st")
    zero = F.lit(0)
    return (t.join(upper, [*by, "__sup"], "left")
            .select(*by, "__seg", (F.coalesce("__p1", zero) + F.coalesce("__p2", zero)).alias(out)))


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], segment: Column,
                value: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` in order."""
    by = list(by)
    keys = [*by, "__seg"]
    d = df.withColumn("__seg", segment.cast("bigint")).withColumn("__val", value)
    d = d.withColumn("__ls", F.sum("__val").over(
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = d.groupBy(*keys).agg(F.sum("__val").alias("__tot"))
    d = d.join(_prefix(totals, by, "__tot", "__pre"), keys, "left")
    return d.withColumn(out, F.coalesce(F.col("__ls"), F.lit(0)) + F.col("__pre")).drop(
        "__seg", "__val", "__ls", "__pre")


def rank_over(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Add the place of each row within its group, from 1, whatever values it is ordered by.

    Rows are sorted into ranges of about equal size, and a range is ranked after the rows of its group in the ranges before it. The ranges are
    written down first, so they are the same whenever a task runs again. ``order`` must be total within ``by``.
    """
    by = list(by)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut(df.repartitionByRange(ranges, *by, *order)).withColumn("__seg", F.spark_partition_id().cast("bigint"))
    before = _prefix(d.groupBy(*by, "__seg").agg(F.count("*").alias("__tot")), by, "__tot", "__pre")
    d = d.withColumn("__rn", F.row_number().over(Window.partitionBy(*by, "__seg").orderBy(*order)))
    return d.join(before, [*by, "__seg"]).withColumn(out, F.col("__rn") + F.col("__pre")).drop("__seg", "__rn", "__pre")


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[str], segment: Column, n: int,
           rank: str | None = None) -> DataFrame:
    """The ``n`` newest rows per group; only segments that can hold one of them are ranked."""
    by = list(by)
    keys = [*by, "__seg"]
    d = df.withColumn("__seg", segment.cast("bigint"))
    newer = _prefix(d.groupBy(*keys).agg(F.count("*").alias("__n")), by, "__n", "__newer", suffix=True)
    d = d.join(newer.filter(F.col("__newer") < n), keys, "inner")
    d = d.withColumn("__rn", F.col("__newer") + F.row_number().over(
        Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])))
    d = d.filter(F.col("__rn") <= n)
    if rank:
        d = d.withColumn(rank, F.col("__rn"))
    return d.drop("__seg", "__newer", "__rn")


def linear_scan(df: DataFrame, by: Sequence[str], order: Sequence[str], segment: Column,
                a: Column, b: Column, out: str) -> DataFrame:
    """State of y_i = a_i * y_(i-1) + b_i, with y before the first row taken as 0.

    Each step is an affine map and affine maps compose, so a segment reduces to one map; the
    maps are folded over segments and the result seeds each segment, whose states are then made one after the other in one Arrow pass. Both
    run over the sorted array of one segment, or of one segment's summaries.
    """
    by = list(by)
    keys = [*by, "__seg"]
    d = (df.withColumn("__seg", segment.cast("bigint"))
         .withColumn("__row", F.struct(*[F.col(o) for o in order], a.cast("double").alias("__a"),
                                       b.cast("double").alias("__b"), F.struct(*df.columns).alias("__all"))))
    segs = d.groupBy(*keys).agg(F.array_sort(F.collect_list("__row")).alias("__rows"))
    ident = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))

    def step(m, x):
        return F.struct((x["__a"] * m["a"]).alias("a"), (x["__a"] * m["b"] + x["__b"]).alias("b"))

    segs = segs.withColumn("__m", F.aggregate("__rows", ident, step))
    seeded = _compose(segs.select(*keys, "__m"), by)
    segs = segs.join(seeded, keys, "left")
    part = lambda name: F.transform("__rows", lambda x: x[name])
    gap = F.array_position(F.transform("__rows", lambda x: x["__a"].isNull() | x["__b"].isNull()), True)  # from the first NULL on there is no state
    ys = _unrolled(part("__a"), part("__b"), F.when(F.col("__y0").isNull(), 0).when(gap > 0, gap - 1).otherwise(F.size("__rows")).cast("int"), F.coalesce("__y0", F.lit(0.0)))
    return (segs.select(F.explode(F.arrays_zip(F.col("__rows").alias("r"), ys.alias("y"))).alias("__z"))
            .select("__z.r.__all.*", F.col("__z.y").alias(out)))


@F.pandas_udf(ArrayType(DoubleType()))
def _unrolled(a: pd.Series, b: pd.Series, known: pd.Series, start: pd.Series) -> pd.Series:
    """All states of a segment, one after the other; NULL behind the first ``known``."""
    def states(a, b, n, y):
        out = list(accumulate(zip(a[:n].tolist(), b[:n].tolist(), strict=True), lambda y, m: m[0] * y + m[1], initial=y))[1:]
        return out + [None] * (len(a) - n)

    return pd.Series([states(*row) for row in zip(a, b, known, start, strict=True)])


def _compose(maps: DataFrame, by: list[str]) -> DataFrame:
    """y at the start of each segment, from one affine map per segment, in two levels."""
    m = maps.withColumn("__sup", F.floor(F.col("__seg") / SUMMARY_FAN))
    step = lambda m0, x: F.struct((x["m"]["a"] * m0["a"]).alias("a"), (x["m"]["a"] * m0["b"] + x["m"]["b"]).alias("b"))
    ident = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))

    def before(d, part, key):
        w = Window.partitionBy(*part).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        item = F.struct(F.col(key).alias("k"), F.col("__m").alias("m"))
        return F.aggregate(F.collect_list(item).over(w), ident, step)

    m = m.withColumn("__in", before(m, [*by, "__sup"], "__seg"))
    upper = m.groupBy(*by, "__sup").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct(F.col("__seg").alias("k"), F.col("__m").alias("m")))),
                    ident, step).alias("__m"))
    upper = upper.withColumn("__up", before(upper, by, "__sup")["b"]).select(*by, "__sup", "__up")
    return (m.join(upper, [*by, "__sup"], "left")
            .select(*by, "__seg", (F.col("__in")["a"] * F.col("__up") + F.col("__in")["b"]).alias("__y0")))
