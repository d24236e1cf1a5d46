"""Outcomes of the legs of a flown pattern."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerotrace.functions import geo
from aerotrace.operators.runtime import cut

# Metres off the line, metres from the target, seconds, and metres from the centre of the map.
LINE_TOLERANCE, ARRIVE_RADIUS, LEG_TIMEOUT, MAP_EXTENT = 2.0, 2.0, 180.0, 100.0


def leg_outcomes(track: DataFrame, pattern: DataFrame, by: Sequence[str] = ("mission_id",), tolerance: float = LINE_TOLERANCE,
                 arrive: float = ARRIVE_RADIUS, timeout: float = LEG_TIMEOUT, extent: float = MAP_EXTENT) -> DataFrame:
    """How each leg ended: ``reached``, ``advanced`` or ``timeout``, after how many seconds, and the largest deviation on the way.

    ``track`` has leg, t, x, y and ``pattern`` leg, x, y, in local metres. A leg is reached at the first fix near its waypoint. It is advanced
    when the aircraft, having been off the line to the next waypoint, is on it again; the last leg has no such line and
    no deviation. ``off_map`` marks legs that end outside the map. A leg takes four sums over its fixes, so it may have any number of them.
    """
    keys = [*by, "leg"]
    here = pattern.select(*keys, F.col("x").alias("ax"), F.col("y").alias("ay"))
    there = pattern.select(*by, (F.col("leg") - 1).alias("leg"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = track.join(here.join(there, keys, "left"), keys)
    d = d.join(cut(track.groupBy(*keys).agg(F.min("t").alias("t0"))), keys).filter(F.col("t") - F.col("t0") < timeout)
    dev = F.when(F.col("bx").isNotNull(), geo.cross_track("ax", "ay", "bx", "by", "x", "y"))
    d = cut(d.select(*keys, "t", "t0", "x", "y", dev.alias("dev"), (F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")) <= arrive).alias("near")))
    first = lambda c: F.min(F.when(c, F.col("t")))
    marks = d.groupBy(*keys).agg(first(F.col("near")).alias("t_near"), first(F.col("dev") > tolerance).alias("t_off"))
    d = d.join(cut(marks), keys)
    ends = d.groupBy(*keys).agg(F.min("t_near").alias("t_near"), first((F.col("dev") <= tolerance) & (F.col("t") > F.col("t_off"))).alias("t_back"), F.min("t0").alias("t0"))
    near_first = F.col("t_near").isNotNull() & (F.col("t_back").isNull() | (F.col("t_near") <= F.col("t_back")))
    ends = cut(ends.select(*keys, "t0", F.when(near_first, "reached").when(F.col("t_back").isNotNull(), "advanced").otherwise("timeout").alias("outcome"),
                           F.least("t_near", "t_back").alias("t_end")))
    d = d.select(*keys, "t", "x", "y", "dev").join(ends, keys)
    seen = F.col("t_end").isNull() | (F.col("t") < F.col("t_end")) | ((F.col("outcome") == "advanced") & (F.col("t") == F.col("t_end")))
    out = d.groupBy(*keys, "outcome").agg(
        F.coalesce(F.min("t_end") - F.min("t0"), F.lit(float(timeout))).alias("seconds"), F.coalesce(F.max(F.when(seen, F.col("dev"))), F.lit(0.0)).alias("max_deviation"),
        F.max_by(F.greatest(F.abs("x"), F.abs("y")) > extent, F.when(F.col("t_end").isNull() | (F.col("t") <= F.col("t_end")), F.col("t"))).alias("off_map"))
    return out


def leg_counts(outcomes: DataFrame, by: Sequence[str] = ("mission_id",)) -> DataFrame:
    """Legs of each mission by outcome."""
    count = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    return outcomes.groupBy(*by).agg(F.count("*").alias("legs"), count("reached"), count("advanced"), count("timeout"))
