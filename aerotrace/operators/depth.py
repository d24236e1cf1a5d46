"""Depth maps as pixel tables (scene, view, u, v, depth, conf, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerotrace.functions import rotations as rot
from aerotrace.operators import ordered
from aerotrace.operators.ranks import exact_percentile

VIEW = ("scene", "view")

# Bad images per scene, by name ending.
DENIED = {
    "delivery_area": ["711.JPG", "712.JPG", "713.JPG", "714.JPG"],
    "electro": ["9289.JPG", "9290.JPG", "9291.JPG", "9292.JPG", "9293.JPG", "9298.JPG"],
    "playground": ["587.JPG", "588.JPG", "589.JPG", "590.JPG", "591.JPG", "592.JPG"],
    "relief": ["427.JPG", "428.JPG", "429.JPG", "430.JPG", "431.JPG", "432.JPG", "433.JPG", "434.JPG", "435.JPG", "436.JPG", "437.JPG", "438.JPG"],
    "relief_2": ["458.JPG", "459.JPG", "460.JPG", "461.JPG", "462.JPG", "463.JPG", "464.JPG", "465.JPG", "466.JPG", "467.JPG", "468.JPG"],
}


def finite(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def valid_depth(df: DataFrame, keys: Sequence[str] = VIEW, pct: float = 0.1, min_share: float = 0.02) -> DataFrame:
    """Add ``valid``: finite depth, not sky, confident. Frames left nearly empty keep every finite pixel."""
    keys = list(keys)
    p = exact_percentile(df.filter(finite("conf")), keys, "conf", {"__thr": pct})
    d = df.join(p, keys, "left")
    sure = finite("depth") & (F.col("sky").isNull() | (F.col("sky") < 0.5)) & (F.col("__thr").isNull() | (F.col("conf") >= F.col("__thr")))
    d = d.withColumn("__ok", F.coalesce(sure, F.lit(False)))
    share = d.groupBy(*keys).agg(F.avg(F.col("__ok").cast("double")).alias("__share"))
    return d.join(share, keys).withColumn("valid", F.when(F.col("__share") > min_share, F.col("__ok")).otherwise(finite("depth"))).drop("__thr", "__ok", "__share")


def fill_sky(df: DataFrame, by: Sequence[str] = ("scene",), pct: float | None = 0.98, max_depth: float = 200.0) -> DataFrame:
    """Sky pixels take a far depth (a percentile of the rest, or a constant) and confidence 1."""
    by, sky = list(by), F.col("sky") >= 0.5
    if pct is None:
        d = df.withColumn("__far", F.lit(max_depth))
    else:
        d = df.join(exact_percentile(df.filter(~sky), by, "depth", {"__far": pct}), by, "left")
    return d.withColumns({"depth": F.when(sky, F.coalesce("__far", "depth")).otherwise(F.col("depth")), "conf": F.when(sky, 1.0).otherwise(F.col("conf"))}).drop("__far")


def mask_background(df: DataFrame, black: bool = True, white: bool = True) -> DataFrame:
    """Near-black and near-white pixels get confidence 1, which a threshold above 1 removes."""
    rgb = [F.col(c) for c in ("red", "green", "blue")]
    hit = F.lit(False)
    if black:
        hit = hit | (F.greatest(*rgb) < 16)
    if white:
        hit = hit | (F.least(*rgb) >= 240)
    return df.withColumn("conf", F.when(hit, 1.0).otherwise(F.col("conf")))


def mask_depth(pred: DataFrame, gt: DataFrame, keys: Sequence[str] = (*VIEW, "u", "v"), scale: float = 1.0) -> DataFrame:
    """Predicted depth where the truth is usable, NULL elsewhere; the scale is applied last.

    ``gt`` has ``gt_depth`` and ``occluded``. A pixel without a row of truth, or with a NULL or NaN one, has no usable truth.
    """
    d = pred.join(gt, list(keys), "left")
    ok = ~F.coalesce(F.col("occluded"), F.lit(False)) & F.coalesce(finite("gt_depth") & (F.col("gt_depth") != 0), F.lit(False)) & finite("depth")
    return d.withColumn("depth", F.when(ok, F.col("depth") * scale)).drop("gt_depth", "occluded")


def drop_denied(images: DataFrame, deny: dict[str, list[str]] = DENIED, name: str = "image") -> DataFrame:
    """Drop images whose name ends with a denied suffix of their scene."""
    rows = [(s, list(x)) for s, x in deny.items()]
    table = images.sparkSession.createDataFrame(rows, "scene string, __deny array<string>")
    d = images.join(F.broadcast(table), "scene", "left")
    hit = F.exists(F.coalesce("__deny", F.expr("cast(array() as array<string>)")), lambda s: F.endswith(F.col(name), s))
    return d.filter(~hit).drop("__deny")


def depth_stats(df: DataFrame, keys: Sequence[str] = VIEW) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max"), F.avg("depth").alias("depth_mean"))


def stretch(df: DataFrame, keys: Sequence[str] = VIEW, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Depth between two percentiles of its frame as 0-1."""
    keys = list(keys)
    d = df.join(exact_percentile(df, keys, "depth", {"__lo": lo, "__hi": hi}), keys, "left")
    flat = F.col("__hi") - F.col("__lo") < 1e-12
    low = df.groupBy(*keys).agg(F.min("depth").alias("__min"))
    d = d.join(low, keys, "left").withColumns({"__lo": F.when(flat, F.col("__min")).otherwise(F.col("__lo")), "__hi": F.when(flat, F.col("__min") + 1e-6).otherwise(F.col("__hi"))})
    x = (F.col("depth") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    return d.withColumn("norm", F.when(F.col("depth").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))).drop("__lo", "__hi", "__min")


def rank_norm(df: DataFrame, keys: Sequence[str] = VIEW, bins: int = 1 << 16) -> DataFrame:
    """Cumulative share of the frame's pixels at or below each pixel's depth bin; NULL for a pixel without depth."""
    keys = list(keys)
    ext = df.groupBy(*keys).agg(F.min("depth").alias("__lo"), F.max("depth").alias("__hi"), F.count("depth").alias("__n"))
    d = df.join(ext, keys)
    span = F.col("__hi") - F.col("__lo")
    d = d.withColumn("__bin", F.when(F.col("depth").isNull(), None).when(span < 1e-12, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("depth") - F.col("__lo")) * (bins - 1) / span))))
    hist = d.filter(F.col("depth").isNotNull()).groupBy(*keys, "__bin").agg(F.count("*").alias("__c"))
    cum = hist.withColumn("__cum", F.sum("__c").over(Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))).drop("__c")
    d = d.join(cum, [*keys, "__bin"], "left")
    return d.withColumn("norm", F.when(F.col("depth").isNotNull(), F.when(span < 1e-12, 0.0).otherwise(F.col("__cum") / F.col("__n")))).drop("__lo", "__hi", "__n", "__bin", "__cum")


def conf_threshold(df: DataFrame, by: Sequence[str] = ("scene",), base: float = 1.05, lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """Confidence threshold kept between two percentiles of the pixels that are not sky.

    Scenes with ten such pixels or fewer use all their pixels.
    """
    by = list(by)
    ground = F.coalesce(F.col("sky") < 0.5, F.lit(True))
    n = df.groupBy(*by).agg(F.count_if(ground).alias("__g"))
    d = df.join(n, by).filter((F.col("__g") <= 10) | ground)
    p = exact_percentile(d, by, "conf", {"__lo": lo, "__hi": hi})
    return p.select(*by, F.least(F.greatest(F.lit(base), F.col("__lo")), F.col("__hi")).alias("threshold"))


def least_squares_scale(df: DataFrame, by: Sequence[str], a: str = "metric", b: str = "depth") -> DataFrame:
    """Scale s that minimises the squared difference of a and s * b."""
    return df.groupBy(*by).agg((F.sum(F.col(a) * F.col(b)) / F.greatest(F.sum(F.col(b) * F.col(b)), F.lit(1e-12))).alias("scale"))


def unproject_depth(df: DataFrame, cams: DataFrame, threshold: DataFrame | None = None, keys: Sequence[str] = VIEW) -> DataFrame:
    """World points of valid pixels. ``cams`` has intrinsics and the world-to-camera ``m`` (16 cells).

    One row per view makes the camera table small against its pixels; Spark picks the join.
    """
    d = df.filter(finite("depth") & (F.col("depth") > 0))
    if threshold is not None:
        d = d.join(threshold, ["scene"]).filter(F.col("conf") >= F.col("threshold")).drop("threshold")
    c = cams.withColumn("__c2w", rot.se3_inverse(F.col("m"))).select(*keys, "fx", "fy", "cx", "cy", "__c2w")
    d = d.join(c, list(keys)).withColumn("__p", rot.unproject("u", "v", "depth", "fx", "fy", "cx", "cy"))
    d = d.withColumn("__w", rot.apply(F.col("__c2w"), F.col("__p.x"), F.col("__p.y"), F.col("__p.z")))
    return d.withColumns({k: F.col(f"__w.{k}") for k in "xyz"}).drop("__c2w", "__p", "__w", "fx", "fy", "cx", "cy")


def consistent_points(df: DataFrame, cams: DataFrame, dist: float = 0.2, min_views: int = 4) -> DataFrame:
    """Mean of the points that agree across views, for pixels at least ``min_views`` views confirm.

    A view can confirm a point only if one of its own points is within ``dist``. An index from places to views tells
    which ones do: the cells of a coarse grid that the views' points reach, each cell and view once. Only into those cameras
    a point is projected, and it meets the pixel it lands on by an equi-join. The reference view counts as one.
    """
    pts = unproject_depth(df, cams).select("scene", "view", "u", "v", "x", "y", "z")
    side, reach = 4 * dist or 1.0, dist * 1.001  # a little wider, so that rounding loses no view
    at = {f"__c{k}": F.floor(F.col(k) / side) for k in "xyz"}
    seen = pts.select("scene", F.col("view").alias("sv"), *[F.sequence(F.floor((F.col(k) - reach) / side), F.floor((F.col(k) + reach) / side)).alias(f"__c{k}") for k in "xyz"]).distinct()
    for c in at:
        seen = seen.withColumn(c, F.explode(c))
    c = F.struct("fx", "fy", "cx", "cy", "m").alias("c")
    d = pts.withColumns(at).join(seen.distinct(), ["scene", *at]).drop(*at).join(cams.select("scene", F.col("view").alias("sv"), c), ["scene", "sv"])
    d = d.withColumn("q", rot.apply(F.col("c.m"), "x", "y", "z")).filter(F.col("q.z") > 0)
    d = d.withColumn("px", rot.project(F.col("q.x"), F.col("q.y"), F.col("q.z"), F.col("c.fx"), F.col("c.fy"), F.col("c.cx"), F.col("c.cy")))
    d = d.select("scene", "view", "u", "v", "x", "y", "z", "sv", F.round("px.u").cast("bigint").alias("su"), F.round("px.v").cast("bigint").alias("svv"))
    src = pts.select("scene", F.col("view").alias("sv"), F.col("u").cast("bigint").alias("su"), F.col("v").cast("bigint").alias("svv"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"))
    d = d.join(src, ["scene", "sv", "su", "svv"])
    sq = sum(((F.col(a) - F.col(f"s{a}")) * (F.col(a) - F.col(f"s{a}")) for a in "yz"), (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")))
    g = d.filter(F.sqrt(sq) < dist).groupBy("scene", "view", "u", "v").agg(F.count("*").alias("n_views"), *[F.avg(f"s{a}").alias(a) for a in "xyz"])
    return g.filter(F.col("n_views") >= min_views)


def point_observations(df: DataFrame, cams: DataFrame, pct: float = 0.4) -> DataFrame:
    """Which pixel of which view saw each point, in pixels of the original images.

    ``cams`` also has the sizes ``orig_w`` and ``orig_h`` of the original images and ``model_w`` and ``model_h`` of the depth maps. Point numbers follow (view, v, u) within a scene.
    """
    thr = exact_percentile(df, ["scene"], "conf", {"threshold": pct})
    d = unproject_depth(df, cams, thr)
    widest = cams.groupBy("scene").agg(F.max("model_w").cast("bigint").alias("__w"), F.max(F.col("model_h").cast("bigint")).alias("__h"))
    place = (F.col("view") * F.col("__w") * F.col("__h") + F.col("v") * F.col("__w") + F.col("u")).cast("bigint")
    d = d.join(widest, "scene").withColumn("__place", place).drop("__w", "__h")
    d = ordered.running_sum(d, ["scene"], ["__place"], F.floor(F.col("__place") / 4096), F.lit(1), "point_id")
    d = d.join(cams.select("scene", "view", "orig_w", "orig_h", "model_w", "model_h", "fx", "fy"), ["scene", "view"])
    sx, sy = F.col("orig_w") / F.col("model_w"), F.col("orig_h") / F.col("model_h")
    return d.withColumns({"orig_u": F.col("u") * sx, "orig_v": F.col("v") * sy, "orig_fx": F.col("fx") * sx, "orig_fy": F.col("fy") * sy}).drop("__place", "fx", "fy", "orig_w", "orig_h", "model_w", "model_h")


def pixel_quality(pixels: DataFrame, h: int, w: int, keys: Sequence[str] = ("image_id",), value: str = "gray") -> DataFrame:
    """Sharpness (variance of the Laplacian), brightness and contrast of each crop.

    Neighbours past an edge are mirrored about the edge pixel. Crops have a fixed size of h x w.
    """
    keys = list(keys)
    rows, cols = Window.partitionBy(*keys, "c").orderBy("r"), Window.partitionBy(*keys, "r").orderBy("c")
    v = F.col(value).cast("double")
    back, ahead = (lambda w_: F.coalesce(F.lag(v).over(w_), F.lead(v).over(w_))), (lambda w_: F.coalesce(F.lead(v).over(w_), F.lag(v).over(w_)))
    lap = back(rows) + ahead(rows) + back(cols) + ahead(cols) - 4 * v
    return pixels.withColumn("__lap", lap).groupBy(*keys).agg(F.var_pop("__lap").alias("sharpness"), F.avg(v).alias("brightness"), F.stddev_pop(v).alias("contrast"))
