"""Per-frame detections: geometry, gates, vetoes, tiles and fusion.

A frame holds at most a few hundred boxes (the detector's own limit per image times its tiles),
so joins on (mission, frame) and arrays per frame stay small however long the mission is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerotrace.functions import boxes as bx
from aerotrace.functions import geo

FRAME_KEYS = ("mission_id", "frame")
FRAME_W, FRAME_H = 1920, 1080

# Fixed values of the detector rules.
FOV_RATIO = 0.80
EXPAND = 1.5
MIN_SHARPNESS, MIN_BRIGHTNESS, MIN_CONTRAST = 20, 30, 10
MIN_BOX_PX, MAX_BOX_FRAC = 8, 0.55
SHAPE_MIN_FILL, SHAPE_MIN_COMPACT, SHAPE_MAX_ELONG, SHAPE_MAX_FILL = 0.22, 0.12, 5.5, 0.95
PERSON_MIN_M, PERSON_MAX_M = 0.30, 2.40
SHADOW_IOU = 0.3
VETO_IOA, VETO_MIN_CONF, VETO_RATIO = 0.55, 0.15, 0.90
SEAM_MARGIN = 3
FUSE_IOU, CONSENSUS_GAIN = 0.55, 0.55
CONSENSUS_MIN_VIEW, CONSENSUS_MIN_PEAK, CONSENSUS_REF_COVER = 0.20, 0.15, 3.0
MIN_CONF, SHADOW_REJECT, SHADOW_WEIGHT = 0.40, 0.25, 0.5
MAX_CONF = 0.999
TILE_SCALE, TILE_OVERLAP, TILE_MAX, TILE_MIN_FRAME, IMGSZ = 0.67, 0.25, 12, 900, 640

# Person score, feature -> (mean, scale, coefficient), and its bias.
PERSON_FEATURES = {
    "chrom_p90": (3.48013, 3.05664, 1.63414),
    "v_ratio": (3.28767, 2.16383, 1.08051),
    "tex": (6.00445, 7.03779, 0.23099),
    "hue_dist": (0.38083, 0.25767, 1.31146),
    "sat_ratio": (0.87635, 0.23032, 0.41786),
    "green_frac": (0.35209, 0.28619, 0.44079),
    "dark_flat": (0.29518, 0.17368, 0.18696),
}
PERSON_BIAS = 0.62426


def fov_filter(df: DataFrame, ratio: float = FOV_RATIO, w: int = FRAME_W, h: int = FRAME_H) -> DataFrame:
    """Keep boxes whose centre lies in the central part of the frame, edges included."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    mx, my = (w - w * ratio) / 2, (h - h * ratio) / 2
    return df.filter(cx.between(mx, mx + w * ratio) & cy.between(my, my + h * ratio))


def square_expand(df: DataFrame, scale: float = EXPAND, w: int = FRAME_W, h: int = FRAME_H) -> DataFrame:
    """Grow the short side to a square, clip, then enlarge about the centre and clip again.

    Corners are whole pixels and halves round down, as for the crops themselves.
    """
    def clip(x1, y1, x2, y2):
        lo = lambda c: F.greatest(c, F.lit(0)).cast("bigint")
        return lo(x1), lo(y1), F.least(x2, F.lit(w)).cast("bigint"), F.least(y2, F.lit(h)).cast("bigint")

    x1, y1, x2, y2 = (c.cast("bigint") for c in bx.box())
    bw, bh = x2 - x1, y2 - y1
    gx, gy = F.greatest(bh - bw, F.lit(0)), F.greatest(bw - bh, F.lit(0))
    hx, hy = F.floor(gx / 2), F.floor(gy / 2)
    d = df.withColumn("__sq", F.array(*clip(x1 - hx, y1 - hy, x2 + (gx - hx), y2 + (gy - hy))))
    s = [F.col("__sq")[i] for i in range(4)]
    half = F.floor(F.floor((s[2] - s[0]) * scale) / 2)
    cx, cy = F.floor((s[0] + s[2]) / 2), F.floor((s[1] + s[3]) / 2)
    d = d.withColumn("__ex", F.array(*clip(cx - half, cy - half, cx + half, cy + half)))
    return d.withColumns({f"crop_{n}": F.col("__ex")[i] for i, n in enumerate(bx.XYXY)}).drop("__sq", "__ex")


def expand_float(df: DataFrame, scale: float = EXPAND, w: int = FRAME_W, h: int = FRAME_H) -> DataFrame:
    """The live runner's crop: both sides enlarged, corners cut to whole pixels; NULL below 8 px."""
    x1, y1, x2, y2 = bx.box()
    cx, cy, hw, hh = (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) * scale / 2, (y2 - y1) * scale / 2
    whole = lambda c: c.cast("bigint")
    a, b = F.greatest(whole(cx - hw), F.lit(0)), F.greatest(whole(cy - hh), F.lit(0))
    c, e = F.least(whole(cx + hw), F.lit(w)), F.least(whole(cy + hh), F.lit(h))
    ok = (c - a >= 8) & (e - b >= 8)
    return df.withColumns({f"crop_{n}": F.when(ok, v) for n, v in zip(bx.XYXY, (a, b, c, e))})


def quality_gates(df: DataFrame, w: int = FRAME_W, h: int = FRAME_H) -> DataFrame:
    """Add ``reject_reason``: the first gate that fails, or NULL."""
    x1, y1, x2, y2 = (F.col(f"crop_{n}") for n in bx.XYXY)
    invalid = (x1 < 0) | (y1 < 0) | (x2 > w) | (y2 > h) | (x2 <= x1) | (y2 <= y1)
    reason = (F.when(invalid, "invalid").when(F.col("sharpness") < MIN_SHARPNESS, "blur")
              .when(F.col("brightness") < MIN_BRIGHTNESS, "dark").when(F.col("contrast") < MIN_CONTRAST, "flat"))
    return df.withColumn("reject_reason", reason)


def geometry_ok(max_aspect=7.0, w: int = FRAME_W, h: int = FRAME_H) -> Column:
    """Box side, area and aspect limits, on whole pixels clipped to the frame."""
    x1, y1, x2, y2 = bx.box()
    px1 = F.greatest(F.least(x1, F.lit(w - 1)), F.lit(0)).cast("bigint")
    py1 = F.greatest(F.least(y1, F.lit(h - 1)), F.lit(0)).cast("bigint")
    bw = F.greatest(F.least(x2, F.lit(w)), F.lit(0)).cast("bigint") - px1
    bh = F.greatest(F.least(y2, F.lit(h)), F.lit(0)).cast("bigint") - py1
    aspect = F.greatest(bh / F.greatest(bw, F.lit(1e-6)), bw / F.greatest(bh, F.lit(1e-6)))
    return (bw >= MIN_BOX_PX) & (bh >= MIN_BOX_PX) & (bw * bh <= MAX_BOX_FRAC * w * h) & (aspect <= max_aspect)


def geometry_gate(df: DataFrame, max_aspect: float = 7.0) -> DataFrame:
    return df.filter(geometry_ok(max_aspect))


def shape_verdict(fill="fill", compact="compact", elong="elong", min_fill=SHAPE_MIN_FILL,
                  min_compact=SHAPE_MIN_COMPACT, max_elong=SHAPE_MAX_ELONG, max_fill=SHAPE_MAX_FILL) -> Column:
    """Reason a mask outline is refused; NULL keeps it, and a missing mask is always kept."""
    f, c, e = F.col(fill), F.col(compact), F.col(elong)
    return (F.when(f.isNull(), None).when(f < min_fill, "sliver").when(c < min_compact, "ragged")
            .when(e > max_elong, "elongated").when(f > max_fill, "solid"))


def size_verdict(major_px: Column, gsd: Column, lo: float = PERSON_MIN_M, hi: float = PERSON_MAX_M) -> Column:
    """Reason a physical size is refused; NULL keeps it, as does an unknown scale."""
    m = major_px * gsd
    return F.when(gsd.isNull() | (gsd == 0) | major_px.isNull(), None).when(m < lo, "too_small").when(m > hi, "too_large")


def person_score(features: dict[str, Column] | None = None) -> Column:
    """Logistic likelihood of a person; NULL when any feature is missing."""
    z = F.lit(PERSON_BIAS)
    for name, (mean, scale, coef) in PERSON_FEATURES.items():
        v = features[name] if features else F.col(name)
        v = F.when(F.isnan(v), 0.0).otherwise(v)
        v = F.when(v > 1e4, 1e4).when(v < -1e4, -1e4).otherwise(v)
        z = z + (v - mean) / scale * coef
    z = F.when(z > 30, 30.0).when(z < -30, -30.0).otherwise(z)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def confidence_adjust(p: Column, weight=SHADOW_WEIGHT) -> Column:
    """Multiplier that lowers doubtful boxes and never raises one; 1 without an opinion."""
    return F.when(p.isNull() | (p >= 0.5), 1.0).otherwise(1.0 - weight * (0.5 - p) / 0.5)


# Thresholds of the two environments and three speeds.
ENVIRONMENTS = {
    "grass": dict(shadow_reject=SHADOW_REJECT, shadow_weight=SHADOW_WEIGHT, max_aspect=7.0, shape_gate=False),
    "urban": dict(shadow_reject=0.0, shadow_weight=0.0, max_aspect=4.5, shape_gate=True),
}
SPEEDS = {
    "fast": dict(tile_scale=0.45, conf_floor=0.06),
    "balanced": dict(tile_scale=0.67, conf_floor=0.06),
    "thorough": dict(tile_scale=0.67, conf_floor=0.04),
}
PROFILE_SCHEMA = ("profile string, env string, speed string, tile_scale double, conf_floor double, "
                  "shadow_reject double, shadow_weight double, max_aspect double, shape_gate boolean, "
                  "min_fill double, min_compact double, max_elong double, max_fill double, min_conf double")


def profile(name: str = "balanced") -> dict:
    """Thresholds of a profile such as ``urban-fast``; the words may come in any order."""
    words = [w for w in name.lower().replace("/", "-").replace("_", "-").split("-") if w]
    unknown = [w for w in words if w not in ENVIRONMENTS and w not in SPEEDS]
    envs, speeds = {w for w in words if w in ENVIRONMENTS}, {w for w in words if w in SPEEDS}
    if unknown or len(envs) > 1 or len(speeds) > 1:
        raise ValueError(f"bad profile {name!r}: unknown {unknown}, environments {envs}, speeds {speeds}")
    env, speed = (envs or {"grass"}).pop(), (speeds or {"balanced"}).pop()
    p = dict(profile=f"{env}-{speed}", env=env, speed=speed, min_fill=SHAPE_MIN_FILL, min_compact=SHAPE_MIN_COMPACT,
             max_elong=SHAPE_MAX_ELONG, max_fill=SHAPE_MAX_FILL, min_conf=MIN_CONF, **ENVIRONMENTS[env], **SPEEDS[speed])
    if speed == "thorough":
        p["shadow_reject"] = min(p["shadow_reject"], 0.10)
        if p["shape_gate"]:
            p.update(min_fill=SHAPE_MIN_FILL * 0.7, min_compact=SHAPE_MIN_COMPACT * 0.7, max_elong=SHAPE_MAX_ELONG * 1.3)
    return p


def profiles(spark: SparkSession) -> DataFrame:
    """All six profiles, to be joined on ``profile`` (a table of fixed size)."""
    cols = [c.split()[0] for c in PROFILE_SCHEMA.split(", ")]
    rows = [profile(f"{e}-{s}") for e in ENVIRONMENTS for s in SPEEDS]
    return spark.createDataFrame([tuple(p[c] for c in cols) for p in rows], PROFILE_SCHEMA)


def with_profile(df: DataFrame, key: str = "profile") -> DataFrame:
    return df.join(F.broadcast(profiles(df.sparkSession)), key)


def min_conf(df: DataFrame, threshold: float = MIN_CONF) -> DataFrame:
    return df.filter(F.col("conf") >= threshold)


def stride(df: DataFrame, n: int | None = None, fps: float | None = None, target: float | None = None) -> DataFrame:
    """Every n-th frame, or n from a target rate."""
    step = n if n is not None else max(1, int(fps / target))
    return df.filter(F.col("frame") % step == 0)


def suppress_overlaps(df: DataFrame, negatives: Sequence[str] = ("shadow",), threshold: float = SHADOW_IOU,
                      keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Positive boxes that no negative box of the frame overlaps by ``threshold`` IoU or more."""
    neg = df.filter(F.col("label").isin(*negatives)).select(*keys, *bx.XYXY).distinct().alias("n")
    pos = df.filter(~F.col("label").isin(*negatives)).alias("p")
    cond = [F.col(f"p.{k}") == F.col(f"n.{k}") for k in keys]
    return pos.join(neg, [*cond, bx.iou(bx.box("p."), bx.box("n.")) >= threshold], "left_anti")


def negative_veto(pos: DataFrame, neg: DataFrame, keys: Sequence[str] = FRAME_KEYS, ioa=VETO_IOA,
                  min_conf=VETO_MIN_CONF, ratio=VETO_RATIO) -> DataFrame:
    """Drop positives that a confident enough negative covers; both carry ``raw_conf``."""
    strong = (neg.filter(F.col("raw_conf") >= min_conf).groupBy(*keys, *bx.XYXY)
              .agg(F.max("raw_conf").alias("raw_conf")).alias("n"))
    p = pos.alias("p")
    cond = [F.col(f"p.{k}") == F.col(f"n.{k}") for k in keys]
    return p.join(strong, [*cond, bx.ioa(bx.box("p."), bx.box("n.")) >= ioa,
                           F.col("n.raw_conf") >= F.col("p.raw_conf") * ratio], "left_anti")


def _tile_grid(d: DataFrame, raw_tw: Column, overlap: float) -> DataFrame:
    """Tile size and origins along both axes, in steps so that no expression is repeated."""
    half_even = lambda c: F.bround(c).cast("bigint")
    d = d.withColumn("__r", half_even(raw_tw))
    d = d.withColumns({"__tw": F.least("__r", "w"), "__th": F.least(half_even(F.col("__r") * F.col("h") / F.col("w")), F.col("h"))})
    for axis, size in (("w", "__tw"), ("h", "__th")):
        d = d.withColumns({f"__s{axis}": F.greatest(half_even(F.col(size) * (1.0 - overlap)), F.lit(1)).cast("bigint"),
                           f"__m{axis}": F.greatest(F.col(axis) - F.col(size), F.lit(0))})
        # origins every step, plus one flush with the far edge when the last step stops short
        whole = F.floor(F.col(f"__m{axis}") / F.col(f"__s{axis}"))
        d = d.withColumn(f"__k{axis}", whole)
        d = d.withColumn(f"__n{axis}", F.col(f"__k{axis}") + F.when(
            F.col(f"__k{axis}") * F.col(f"__s{axis}") < F.col(f"__m{axis}"), 2).otherwise(1))
    return d


def plan_tiles(sizes: DataFrame, scale: float = TILE_SCALE, overlap: float = TILE_OVERLAP, imgsz: int = IMGSZ,
               max_tiles: int = TILE_MAX, min_frame: int = TILE_MIN_FRAME) -> DataFrame:
    """Overlapping tiles that cover each (w, h); none for frames too small to tile.

    A grid over the budget is planned once more with larger tiles.
    """
    keep = sizes.columns
    d = _tile_grid(sizes.filter(F.col("w") >= min_frame), F.lit(imgsz / scale), overlap)
    n = F.col("__nw") * F.col("__nh")
    d = d.withColumn("__raw", F.when(n > max_tiles, imgsz / (scale / F.sqrt(n / float(max_tiles)))).otherwise(imgsz / scale))
    d = _tile_grid(d.select(*keep, "__raw"), F.col("__raw"), overlap)
    for axis in ("h", "w"):
        d = d.withColumn(f"__i{axis}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"__n{axis}") - 1)))
    return d.select(
        *keep, F.least(F.col("__iw") * F.col("__sw"), F.col("__mw")).alias("x1"), F.least(F.col("__ih") * F.col("__sh"), F.col("__mh")).alias("y1"),
        "__tw", "__th").withColumns({"x2": F.least(F.col("x1") + F.col("__tw"), F.col("w")),
                                     "y2": F.least(F.col("y1") + F.col("__th"), F.col("h"))}).drop("__tw", "__th")


def coverage(df: DataFrame, tiles: DataFrame) -> DataFrame:
    """Number of images that could see a box: the full frame and every tile with its centre.

    The tile plan of one frame size has at most a few dozen rows, so it travels as one array.
    """
    plan = tiles.groupBy("w", "h").agg(F.collect_list(F.struct(*bx.XYXY)).alias("__tiles"))
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    d = df.join(plan, ["w", "h"], "left").withColumns({"__cx": cx, "__cy": cy})
    seen = F.filter("__tiles", lambda t: (t["x1"] <= F.col("__cx")) & (F.col("__cx") < t["x2"])
                    & (t["y1"] <= F.col("__cy")) & (F.col("__cy") < t["y2"]))
    return d.withColumn("cover", F.lit(1) + F.coalesce(F.size(seen), F.lit(0))).drop("__tiles", "__cx", "__cy")


def drop_seam_fragments(df: DataFrame, w: int = FRAME_W, h: int = FRAME_H, margin: int = SEAM_MARGIN) -> DataFrame:
    """Move tile boxes to frame coordinates and drop those cut by an inner tile edge.

    Needs the tile corners ``tx1..ty2``; boxes are in tile coordinates.
    """
    x1, y1, x2, y2 = bx.box()
    tx1, ty1, tx2, ty2 = (F.col(f"t{n}") for n in bx.XYXY)
    cut = (((x1 <= margin) & (tx1 > 0)) | ((y1 <= margin) & (ty1 > 0))
           | ((x2 >= tx2 - tx1 - margin) & (tx2 < w)) | ((y2 >= ty2 - ty1 - margin) & (ty2 < h)))
    return df.filter(~cut).withColumns({"x1": x1 + tx1, "y1": y1 + ty1, "x2": x2 + tx1, "y2": y2 + ty1})


def fuse_boxes(df: DataFrame, keys: Sequence[str] = FRAME_KEYS, iou_thr: float = FUSE_IOU,
               gain: float = CONSENSUS_GAIN, min_view: float = CONSENSUS_MIN_VIEW,
               min_peak: float = CONSENSUS_MIN_PEAK, ref_cover: float = CONSENSUS_REF_COVER) -> DataFrame:
    """Merge overlapping boxes of a frame into confidence-weighted ones.

    Boxes are visited by falling confidence. A box joins the first earlier seed it overlaps by
    ``iou_thr`` and becomes a seed otherwise; the fold runs over the frame's own box array.
    Agreement of the other views raises confidence by a bounded bonus. A ``cover`` column, when
    present, scales that bonus to the number of images that could have seen the box.
    """
    keys = list(keys)
    has_cover = "cover" in df.columns
    cover = F.col("cover") if has_cover else F.lit(None).cast("int")
    item = F.struct((-F.col("conf")).alias("o"), F.col("det_id"), *bx.XYXY, F.col("conf"), F.col("label"), cover.alias("cover"))
    frames = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__b"))
    corner = lambda s: (s["x1"], s["y1"], s["x2"], s["y2"])
    seed_type = "array<struct<id:bigint,x1:double,y1:double,x2:double,y2:double>>"
    start = F.struct(F.expr(f"cast(array() as {seed_type})").alias("seeds"), F.expr("cast(array() as array<bigint>)").alias("of"))

    def visit(acc, b):
        hit = F.filter(acc["seeds"], lambda s: bx.iou(corner(s), corner(b)) >= iou_thr)
        mine = F.struct(b["det_id"].cast("bigint").alias("id"), *[b[c].cast("double").alias(c) for c in bx.XYXY])
        new = F.size(hit) == 0
        return F.struct(
            F.when(new, F.concat(acc["seeds"], F.array(mine))).otherwise(acc["seeds"]).alias("seeds"),
            F.concat(acc["of"], F.array(F.when(new, b["det_id"].cast("bigint")).otherwise(F.get(hit, F.lit(0))["id"]))).alias("of"))

    d = frames.withColumn("__of", F.aggregate("__b", start, visit, lambda acc: acc["of"]))
    d = d.select(*keys, F.explode(F.arrays_zip(F.col("__b").alias("b"), F.col("__of").alias("seed"))).alias("z"))
    d = d.select(*keys, "z.seed", "z.b.*")
    w = F.sum("conf")
    g = d.groupBy(*keys, "seed").agg(
        *[(F.sum(F.col(c) * F.col("conf")) / F.greatest(w, F.lit(1e-9))).alias(c) for c in bx.XYXY],
        F.max("conf").alias("raw_conf"), F.count("*").cast("int").alias("n_views"),
        F.sum(F.when(F.col("conf") >= min_view, F.col("conf")).otherwise(0.0)).alias("__q"),
        F.min_by("label", F.struct("o", "det_id")).alias("label"),
        F.min_by("cover", F.struct("o", "det_id")).alias("__cov"))
    rest = F.greatest(F.col("__q") - F.col("raw_conf"), F.lit(0.0))
    n_cov = F.greatest(F.col("__cov"), F.lit(1))
    rest = F.when(F.col("__cov").isNull(), rest).otherwise(rest * (ref_cover - 1.0) / F.greatest(n_cov - 1, F.lit(1)))
    p = F.when(F.col("raw_conf") < min_peak, F.col("raw_conf")).otherwise(
        F.col("raw_conf") + (1.0 - F.col("raw_conf")) * (1.0 - F.exp(-gain * rest)))
    return g.withColumn("conf", F.least(p, F.lit(MAX_CONF))).drop("__q", "__cov")


FUNNEL = ("geom", "veto", "shape", "size", "shadow", "conf", "out")


def gate_reason(df: DataFrame, weight: float = SHADOW_WEIGHT, reject: float = SHADOW_REJECT, max_aspect: float = 7.0,
                shape_gate: bool = False, threshold: float = MIN_CONF) -> DataFrame:
    """Final confidence and the stage at which a fused box leaves the detector.

    Needs ``vetoed``, mask measures (``fill``, ``compact``, ``elong``, ``major_px``), ``gsd`` and
    ``person_score``; each may be NULL.
    """
    ps = F.col("person_score")
    conf = F.least(F.col("conf") * confidence_adjust(ps, weight), F.lit(MAX_CONF))
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).cast("double")
    shape_bad = shape_verdict().isNotNull() if shape_gate else F.lit(False)
    reason = (F.when(~geometry_ok(max_aspect), "geom").when(F.col("vetoed"), "veto").when(shape_bad, "shape")
              .when(size_verdict(F.coalesce(F.col("major_px"), side), F.col("gsd")).isNotNull(), "size")
              .when(F.lit(reject > 0) & ps.isNotNull() & (ps < reject), "shadow")
              .when(conf < threshold, "conf").otherwise("out"))
    return df.withColumns({"conf": conf, "reason": reason})


def funnel(df: DataFrame, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Number of boxes that left at each stage, per frame."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col("reason") == s).alias(s) for s in FUNNEL],
                                 F.count("*").alias("fused"))


def locate_boxes(df: DataFrame, anchor: str = "center", cam: geo.Camera = geo.Camera(), zoom_default: float = 2.0) -> DataFrame:
    """Ground position of each box. Needs the aircraft state columns in degrees and metres.

    ``center`` projects the middle of the box. ``feet`` projects the point a tenth of the height
    above the lower edge and refuses altitudes of half a metre or less.
    """
    from aerotrace.operators.telemetry import zoom_or

    x1, y1, x2, y2 = bx.box()
    d = df.withColumns({
        "__u": x1 + 0.5 * (x2 - x1),
        "__v": y1 + 0.5 * (y2 - y1) if anchor == "center" else y2 - 0.1 * (y2 - y1),
        "__zoom": zoom_or("zoom", zoom_default)})
    ok = F.lit(True) if anchor == "center" else F.col("alt") > 0.5
    return project_pixels(d, "__u", "__v", "__zoom", cam, ok).drop("__u", "__v", "__zoom")


def project_pixels(df: DataFrame, u: str, v: str, zoom: str, cam: geo.Camera = geo.Camera(), ok: Column | None = None) -> DataFrame:
    """``geo.pixel_to_gps`` as a chain of projections, so each intermediate value is computed once."""
    d = df.withColumn("__ray", geo.pixel_ray(u, v, cam, zoom))
    d = d.withColumn("__ray", geo.cam_to_body(F.col("__ray")))
    d = d.withColumns({f"__{n}": F.radians(n) for n in ("roll", "pitch", "yaw")})
    d = d.withColumn("__dir", geo.body_to_world(F.col("__ray"), "__roll", "__pitch", "__yaw"))
    down = (F.col("__dir")["z"] > 0) & (F.lit(True) if ok is None else ok)
    k = F.col("alt") / F.col("__dir")["z"]
    d = d.withColumns({"__north": F.when(down, F.col("__dir")["x"] * k), "__east": F.when(down, F.col("__dir")["y"] * k)})
    d = d.withColumns({"obj_lat": F.nanvl(F.col("lat") + F.col("__north") / geo.m_per_deg_lat("lat"), F.lit(None)),
                       "obj_lon": F.nanvl(F.col("lon") + F.col("__east") / geo.m_per_deg_lon("lat"), F.lit(None))})
    return d.drop("__ray", "__roll", "__pitch", "__yaw", "__dir", "__north", "__east")


def geo_coverage(df: DataFrame, by: Sequence[str] = ("mission_id",), col: str = "obj_lat") -> DataFrame:
    """Share of detections projected to the ground, and the log level it deserves."""
    pct = 100.0 * F.count(col) / F.count("*")
    return df.groupBy(*by).agg(F.count(col).alias("located"), F.count("*").alias("total"), pct.alias("pct"),
                               F.when(pct > 50, "INFO").otherwise("WARN").alias("level"))
