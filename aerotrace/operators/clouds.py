"""Point clouds: nearest neighbours, reconstruction scores, sampling, thinning and alignment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerotrace.functions import rotations as rot
from aerotrace.operators.ranks import exact_percentile
from aerotrace.operators.runtime import cut

XYZ = ("x", "y", "z")
BLOCK = 512


def _cell(size: float, names=XYZ) -> dict[str, Column]:
    return {f"c{k}": F.floor(F.col(k) / size).cast("bigint") for k in names}


def _around() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"))
                               for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))


def _leaves(ref: DataFrame, by: list[str], cell: float) -> DataFrame:
    """Reference points in arrays of about ``BLOCK``, by cell."""
    refs = ref.select(*by, *XYZ).distinct().withColumns(_cell(cell)).withColumn("__b", F.pmod(F.xxhash64(*XYZ), F.lit(2 ** 31 - 1)))
    n = refs.groupBy(*by, "cx", "cy", "cz").agg(F.count("*").alias("__n"))
    packed = refs.join(n, [*by, "cx", "cy", "cz"]).groupBy(*by, "cx", "cy", "cz", F.pmod("__b", F.ceil(F.col("__n") / BLOCK)).alias("__b"))
    return cut(packed.agg(F.collect_list(F.struct(*XYZ)).alias("__r"), *[f(k).alias(f"{n}{k}") for k in XYZ for n, f in (("lo", F.min), ("hi", F.max))]))


def _boxes(d: DataFrame, by: list[str], at: dict[str, Column], extra: Sequence[Column] = ()) -> DataFrame:
    """Boxes around the boxes that share a cell."""
    return d.withColumns(at).groupBy(*by, *at).agg(*[F.min(f"lo{k}").alias(f"lo{k}") for k in XYZ], *[F.max(f"hi{k}").alias(f"hi{k}") for k in XYZ], *extra)


def _reach(near: bool) -> Column:
    """Least, or greatest, distance between a point of the box q and a point of the box r."""
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"q_hi{k}"), F.col(f"q_lo{k}") - F.col(f"hi{k}")) if near else F.greatest(F.col(f"hi{k}") - F.col(f"q_lo{k}"), F.col(f"q_hi{k}") - F.col(f"lo{k}"))
    return F.sqrt(gap("x") * gap("x") + gap("y") * gap("y") + gap("z") * gap("z"))


def _candidates(left: DataFrame, leaves: DataFrame, by: list[str], cell: float, max_r: float | None) -> DataFrame:
    """Cells of references (cx, cy, cz) that may hold the nearest one of some point of a query cell (qx, qy, qz).

    Boxes of references are joined four by four by four into larger ones until a scene has at most a few. Query boxes begin with those and descend: a box whose nearest point is
    farther than another box's farthest is dropped before its parts are looked at.
    """
    cells = ["cx", "cy", "cz"]
    widest = leaves.groupBy(*by).agg(F.greatest(*[F.max(c) - F.min(c) for c in cells]).alias("w")).agg(F.max("w")).first()[0] or 0
    levels = [cut(_boxes(leaves, by, {c: F.col(c) for c in cells}))]
    while 4 ** (len(levels) - 1) < widest:  # at last no scene is wider than two boxes along any axis
        levels.append(_boxes(levels[-1], by, {c: F.floor(F.col(c) / 4) for c in cells}))
    q = left.withColumns({f"{n}{k}": F.col(k) for k in XYZ for n in ("lo", "hi")})
    q = _boxes(q, by, {f"q{k}": F.floor(F.col(k) / cell).cast("bigint") for k in XYZ}).withColumnsRenamed({f"{n}{k}": f"q_{n}{k}" for k in XYZ for n in ("lo", "hi")})
    own = [*by, "qx", "qy", "qz"]
    salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a scene of many boxes is spread; its few roots go to every salt
    roots = levels[-1].withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    d = q.withColumn("__salt", F.pmod(F.xxhash64("qx", "qy", "qz"), F.lit(salts)).cast("int")).join(roots, [*by, "__salt"]).drop("__salt")
    for depth in range(len(levels) - 1, -1, -1):
        d = cut(d.withColumns({"__near": _reach(True), "__far": _reach(False)}))
        bound = d.groupBy(*own).agg(F.min("__far").alias("__bound"))
        d = d.join(bound, own).filter(F.col("__near") <= (F.col("__bound") if max_r is None else F.least("__bound", F.lit(max_r))))
        box = [f"{n}{k}" for k in XYZ for n in ("lo", "hi")]
        d = d.drop("__near", "__far", "__bound", *box)
        if depth:
            parts = levels[depth - 1].withColumnsRenamed({c: f"n{c}" for c in cells}).withColumns({c: F.floor(F.col(f"n{c}") / 4) for c in cells})
            d = d.join(parts, [*by, *cells]).drop(*cells).withColumnsRenamed({f"n{c}": c for c in cells})
    return d.select(*own, *cells)


def nn_distance(query: DataFrame, ref: DataFrame, by: Sequence[str] = ("scene",), ids: Sequence[str] = ("pt",), cell: float = 0.25,
                max_r: float | None = None) -> DataFrame:
    """Distance from each query point to its nearest reference point, as ``distance``.

    References are packed once, into arrays of at most about ``BLOCK`` points of one cell. A point first meets its own cell and those around it; a distance within one cell width is
    final. The others look further through a hierarchy of boxes, and meet only cells that can hold their nearest point, however far away that is. Beyond ``max_r`` the distance is NULL, as in scenes without references.
    """
    by, ids = list(by), list(ids)
    keys, cells, spot = [*by, *ids], ["cx", "cy", "cz"], [*by, *XYZ]
    leaves = _leaves(ref, by, cell)
    points = leaves.select(*by, *cells, "__r")
    have = leaves.select(*by).distinct()
    rows = query.select(*keys, *XYZ)
    none = rows.select(*keys).join(have, by, "left_anti").withColumn("distance", F.lit(None).cast("double"))
    given = lambda names: reduce(and_, [F.col(k).isNotNull() for k in names])
    named, known = given(keys), given([*keys, *XYZ])
    rows = cut(rows.join(have, by, "left_semi"))
    start = cut(rows.filter(known).select(*spot).distinct())  # points at one place have one distance
    d2 = lambda p: sum(((p[k] - F.col(k)) * (p[k] - F.col(k)) for k in "yz"), (p["x"] - F.col("x")) * (p["x"] - F.col("x")))
    least = lambda d: d.withColumn("__d", F.array_min(F.transform("__r", d2))).groupBy(*spot).agg(F.sqrt(F.min("__d")).alias("distance"))
    around = start.withColumns(_cell(cell)).withColumn("o", _around())
    around = around.withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j"), "cz": F.col("cz") + F.col("o.k")}).drop("o")
    # Spark's estimate of a size leaves out what an explode adds, so the exploded side must never be chosen for a broadcast, which passes through the driver
    cur = cut(start.join(least(around.hint("merge").join(points, [*by, *cells])), spot, "left"))
    final = F.coalesce(F.col("distance") <= cell, F.lit(False))
    done, left = cur.filter(final), cur.filter(~final).select(*spot)
    if not left.isEmpty():
        found = _candidates(left, leaves, by, cell, max_r)
        met = left.withColumns({f"q{k}": F.floor(F.col(k) / cell).cast("bigint") for k in XYZ}).hint("merge").join(found, [*by, "qx", "qy", "qz"])
        done = done.unionByName(left.join(least(met.hint("merge").join(points, [*by, *cells])), spot, "left"))
    if max_r is not None:
        done = done.withColumn("distance", F.when(F.col("distance") <= max_r, F.col("distance")))
    done = rows.hint("merge").join(done, spot, "left")
    # rows that share a key share the least of their distances; a row without a key has none
    least_of_key = F.when(named, F.min("distance").over(Window.partitionBy(*keys)))
    return done.select(*keys, least_of_key.alias("distance")).unionByName(none)


def nearest_cells(query: DataFrame, ref: DataFrame, by: Sequence[str], cell: float) -> DataFrame:
    """Pairs of cells (qx, qy, qz) of ``query`` and (cx, cy, cz) of ``ref`` such that the nearest reference of every query point lies in a cell paired with its own."""
    corners = ref.withColumns({f"{n}{k}": F.col(k) for k in XYZ for n in ("lo", "hi")})
    return cut(_candidates(query, cut(_boxes(corners, list(by), _cell(cell))), list(by), cell, None))


def voxel_down(df: DataFrame, size: float, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Mean point of each voxel."""
    return df.withColumns(_cell(size)).groupBy(*by, "cx", "cy", "cz").agg(*[F.avg(k).alias(k) for k in XYZ], F.count("*").alias("n"))


def recon_metrics(pred: DataFrame, gt: DataFrame, threshold: float = 0.05, by: Sequence[str] = ("scene",), ids: Sequence[str] = ("pt",),
                  cell: float | None = None, down_sample: float | None = None) -> DataFrame:
    """Accuracy, completeness, precision, recall and F-score per scene; an empty side scores infinity and 0."""
    by = list(by)
    if down_sample:
        voxel = lambda d: voxel_down(d, down_sample, by).select(*by, F.struct("cx", "cy", "cz").alias(ids[0]), *XYZ)
        pred, gt = voxel(pred), voxel(gt)
    cell = cell or threshold * 4
    scenes = pred.select(*by).unionByName(gt.select(*by)).distinct()

    def side(a, b, mean, share):
        d = nn_distance(a, b, by, ids, cell)
        return d.groupBy(*by).agg(F.avg("distance").alias(mean), F.avg((F.col("distance") < threshold).cast("double")).alias(share))

    d = scenes.join(side(pred, gt, "acc", "precision"), by, "left").join(side(gt, pred, "comp", "recall"), by, "left")
    none = F.col("acc").isNull() | F.col("comp").isNull()
    inf = F.lit(float("inf"))
    d = d.withColumns({c: F.when(none, inf).otherwise(F.col(c)) for c in ("acc", "comp")} | {c: F.when(none, 0.0).otherwise(F.col(c)) for c in ("precision", "recall")})
    s = F.col("precision") + F.col("recall")
    return d.withColumns({"overall": (F.col("acc") + F.col("comp")) / 2, "fscore": F.when(s > 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(0.0)})


def truncated_mean(dist: DataFrame, max_dist: float = 20.0, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Mean distance of the points closer than ``max_dist``."""
    return dist.filter(F.col("distance") < max_dist).groupBy(*by).agg(F.avg("distance").alias("mean"))


def in_observed_volume(points: DataFrame, observed: DataFrame, lo: Sequence[float], hi: Sequence[float], res: float, patch: float = 60.0,
                       by: Sequence[str] = ("scene",)) -> DataFrame:
    """Points inside the padded box whose grid cell is marked as observed."""
    inside = F.lit(True)
    for k, a, b in zip(XYZ, lo, hi):
        inside = inside & (F.col(k) >= a - patch) & (F.col(k) < b + 2 * patch)
    d = points.filter(inside).withColumns({f"i{k}": F.bround((F.col(k) - a) / res).cast("bigint") for k, a in zip(XYZ, lo)})
    return d.join(observed, [*by, "ix", "iy", "iz"], "left_semi").drop("ix", "iy", "iz")


def above_plane(points: DataFrame, plane: Sequence[float]) -> DataFrame:
    a, b, c, d = plane
    return points.filter(a * F.col("x") + b * F.col("y") + c * F.col("z") + d > 0)


def hash_sample(df: DataFrame, n: int, by: Sequence[str], ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows per group (all when there are fewer), by seeded hash order.

    Hashes are uniform, so counting them by their top 16 bits finds the one bucket that has to be
    ranked; the buckets before it are kept whole.
    """
    by = list(by)
    h = F.xxhash64(F.lit(seed), *by, *ids)
    d = df.withColumn("__h", h).withColumn("__k", F.shiftright("__h", 48))
    cnt = d.groupBy(*by, "__k").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by).orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    cum = cnt.withColumn("__end", F.sum("__c").over(w)).select(*by, "__k", (F.col("__end") - F.col("__c")).alias("__start"), "__end")
    d = d.join(cum.filter(F.col("__start") < n), [*by, "__k"])
    whole = d.filter(F.col("__end") <= n)
    part = d.filter(F.col("__end") > n).withColumn("__rn", F.row_number().over(Window.partitionBy(*by, "__k").orderBy("__h", *ids)))
    part = part.filter(F.col("__start") + F.col("__rn") <= n).drop("__rn")
    return whole.unionByName(part).drop("__h", "__k", "__start", "__end")


def cap_points(df: DataFrame, n: int, seed: int = 42, by: Sequence[str] = ("scene",), ids: Sequence[str] = ("pt",)) -> DataFrame:
    """Finite points, at most ``n`` per scene."""
    ok = F.lit(True)
    for k in XYZ:
        ok = ok & F.col(k).isNotNull() & ~F.isnan(k) & (F.abs(k) != float("inf"))
    return hash_sample(df.filter(ok), n, by, ids, seed)


def scene_scale(points: DataFrame, by: Sequence[str] = ("scene",), fallback: float = 1.0) -> DataFrame:
    """Diagonal of the box between the 5th and 95th percentiles."""
    by = list(by)
    d = points.groupBy(*by).agg(F.count("*").alias("__n"))
    for k in XYZ:
        d = d.join(exact_percentile(points, by, k, {f"__lo{k}": 0.05, f"__hi{k}": 0.95}), by)
    sq = sum(((F.col(f"__hi{k}") - F.col(f"__lo{k}")) * (F.col(f"__hi{k}") - F.col(f"__lo{k}")) for k in "yz"), (F.col("__hix") - F.col("__lox")) * (F.col("__hix") - F.col("__lox")))
    diag = F.sqrt(sq)
    return d.select(*by, F.when((F.col("__n") >= 2) & (diag > 0), diag).otherwise(fallback).alias("scale"))


def thin(points: DataFrame, radius: float, by: Sequence[str] = ("scene",), ids: Sequence[str] = ("pt",), seed: int = 42) -> DataFrame:
    """Subset with no two points within ``radius``, to which no further point can be added.

    Rounds keep every point whose seeded hash is the lowest in its neighbourhood and drop those
    it covers. Within a cell only the lowest hash can win, so cells send one candidate each.
    """
    by, ids = list(by), list(ids)
    cols = [*by, *ids, *XYZ]
    side = radius / 1.7320508075688772 / (1 + 1e-9)  # two points of one cell are within the radius
    pts = points.select(*cols).withColumns(_cell(side)).withColumn("__h", F.struct(F.xxhash64(F.lit(seed), *ids).alias("h"), *ids))
    left, kept = cut(pts), []
    cell = [*by, "cx", "cy", "cz"]
    span = [F.sequence(F.lit(-2), F.lit(2))] * 3
    sq = lambda a, b: sum(((F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) * (F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) for k in "yz"),
                          (F.col(f"{a}.x") - F.col(f"{b}.x")) * (F.col(f"{a}.x") - F.col(f"{b}.x")))

    def near(d):
        for k, s in zip(("cx", "cy", "cz"), span):
            d = d.withColumn("__o", F.explode(s)).withColumn(k, F.col(k) + F.col("__o")).drop("__o")
        return d

    while True:
        top = left.groupBy(*cell).agg(F.min(F.struct("__h", *XYZ)).alias("t"))
        a = near(top.select(*cell, F.col("t").alias("a")))
        beaten = a.hint("merge").join(top, cell).filter((F.col("t.__h") < F.col("a.__h")) & (sq("a", "t") <= radius * radius)).select(*by, F.col("a.__h").alias("__h")).distinct()
        win = cut(top.withColumn("__h", F.col("t.__h")).join(beaten, [*by, "__h"], "left_anti").select(*cell, "__h", *[F.col(f"t.{k}").alias(k) for k in XYZ]))
        kept.append(win.select(*by, *[F.col(f"__h.{i}").alias(i) for i in ids], *XYZ))
        cover = near(win.select(*cell, F.struct(*XYZ).alias("w")))
        p = left.withColumn("p", F.struct(*XYZ)).join(cover.hint("merge"), cell)
        gone = p.filter(sq("p", "w") <= radius * radius).select(*by, *ids).distinct()
        left = cut(left.join(gone, [*by, *ids], "left_anti"))
        if left.isEmpty():
            break
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


# ---- poses --------------------------------------------------------------------------------


def align_first(poses: DataFrame, by: Sequence[str] = ("scene",), order: str = "view", m: str = "m") -> DataFrame:
    """Poses relative to the first camera of their scene."""
    first = poses.groupBy(*by).agg(F.min_by(m, order).alias("__m0")).withColumn("__inv", rot.se3_inverse(F.col("__m0"))).drop("__m0")
    return poses.join(first, list(by)).withColumn(m, rot.matmul(F.col(m), F.col("__inv"))).drop("__inv")


PAIR_BLOCK = 64


def pairs(df: DataFrame, by: Sequence[str], order: str, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Every pair i < j of the members of each group, with columns ``left`` of i and ``right`` of j.

    The pairs are the result. Members are dealt to blocks by a hash, so a large group is paired by many tasks, a block against a block.
    """
    by = list(by)
    n = df.groupBy(*by).agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("__nb"))
    d = cut(df.join(n, by).withColumn("__b", F.pmod(F.xxhash64(order), F.col("__nb")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("__nb") - 1))
    a = d.select(*by, F.col(order).alias("i"), *left, F.col("__b").alias("__bi"), other.alias("__bj"))
    b = d.select(*by, F.col(order).alias("j"), *right, F.col("__b").alias("__bj"), other.alias("__bi"))
    return a.join(b, [*by, "__bi", "__bj"]).filter("i < j").drop("__bi", "__bj")


def pose_errors(pred: DataFrame, gt: DataFrame, by: Sequence[str] = ("scene",), order: str = "view") -> DataFrame:
    """Rotation and translation angle errors of every pair of views of a scene; sample the views first where fewer pairs are wanted."""
    by = list(by)
    both = align_first(pred, by, order).withColumnRenamed("m", "mp").join(align_first(gt, by, order), [*by, order])
    both = both.withColumns({"ip": rot.se3_inverse(F.col("mp")), "ig": rot.se3_inverse(F.col("m"))})
    d = pairs(both, by, order, ["ip", "ig"], ["mp", "m"])
    d = d.withColumns({"rp": rot.matmul(F.col("ip"), F.col("mp")), "rg": rot.matmul(F.col("ig"), F.col("m"))}).select(*by, "i", "j", "rp", "rg")
    t = lambda m: [F.col(m)[3], F.col(m)[7], F.col(m)[11]]
    return d.withColumns({"r_err": rot.rot_angle(F.col("rg"), F.col("rp")), "t_err": rot.trans_angle(t("rg"), t("rp"))}).drop("rp", "rg")


def pose_auc(errors: DataFrame, thresholds: Sequence[int] = (3, 5, 15, 30), by: Sequence[str] = ("scene",)) -> DataFrame:
    """Area under the cumulative share of pairs by error, in one-degree bins, the last bin closed.

    The mean of the cumulative histogram equals a weight per pair: a pair in bin b counts in every
    bin from b on.
    """
    e = F.greatest("r_err", "t_err")

    def auc(t):
        b = F.least(F.floor(e), F.lit(t - 1))
        return (F.sum(F.when(e <= t, (t - b) / t).otherwise(0.0)) / F.count("*")).alias(f"auc{t:02d}")

    return errors.groupBy(*by).agg(*[auc(t) for t in thresholds])


def align_sim3(pairs: DataFrame, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Rotation (9 cells), translation and scale that best map estimated to reference positions.

    ``pairs`` has ``x, y, z`` (reference) and ``ex, ey, ez`` (estimate) per view. Means and the
    covariance are plain aggregates; only the 3 x 3 decomposition per scene runs in Python.
    """
    by, est = list(by), ("ex", "ey", "ez")
    mean = pairs.groupBy(*by).agg(*[F.avg(k).alias(f"m{k}") for k in (*XYZ, *est)])
    d = pairs.join(mean, by)
    dev = lambda k: F.col(k) - F.col(f"m{k}")
    cov = d.groupBy(*by, *[f"m{k}" for k in (*XYZ, *est)]).agg(F.array(*[F.avg(dev(a) * dev(b)) for a in XYZ for b in est]).alias("cov"),
                                                               F.avg(sum((dev(k) * dev(k) for k in est[1:]), dev("ex") * dev("ex"))).alias("var"))

    @F.pandas_udf("struct<r:array<double>,s:double>")
    def solve(c: pd.Series, v: pd.Series) -> pd.DataFrame:
        u, s, vt = np.linalg.svd(np.stack(c.map(np.asarray)).reshape(-1, 3, 3))
        flip = np.ones((len(c), 3))
        flip[np.linalg.det(u) * np.linalg.det(vt) < 0, 2] = -1.0
        r = (u * flip[:, None, :]) @ vt
        return pd.DataFrame({"r": list(r.reshape(-1, 9)), "s": (s * flip).sum(1) / v.to_numpy()})

    d = cov.withColumn("f", solve("cov", "var"))
    r, s = F.col("f.r"), F.col("f.s")
    t = [F.col(f"m{k}") - s * (r[3 * i] * F.col("mex") + r[3 * i + 1] * F.col("mey") + r[3 * i + 2] * F.col("mez")) for i, k in enumerate(XYZ)]
    return d.select(*by, r.alias("r"), F.array(*t).alias("t"), s.alias("s"))


def apply_alignment(pairs: DataFrame, model: DataFrame, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Estimated positions in the reference frame, as ``ax, ay, az``, with their error."""
    d = pairs.join(model, list(by)).withColumn("__a", rot.apply_sim3(F.col("r"), F.col("t"), F.col("s"), "ex", "ey", "ez"))
    d = d.withColumns({f"a{k}": F.col(f"__a.{k}") for k in XYZ}).drop("__a", "r", "t", "s")
    sq = sum(((F.col(f"a{k}") - F.col(k)) * (F.col(f"a{k}") - F.col(k)) for k in "yz"), (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")))
    return d.withColumn("error", F.sqrt(sq))


def ransac_sim3(pairs: DataFrame, by: Sequence[str] = ("scene",), ids: Sequence[str] = ("view",), iters: int = 10, seed: int = 42,
                inlier: float | None = None) -> DataFrame:
    """Alignment fitted on the largest agreeing set among ``iters`` half samples of each scene.

    All samples of all scenes are fitted in the same job. The inlier distance defaults to the
    median distance of a pre-aligned position to its nearest reference position.
    """
    by, ids = list(by), list(ids)
    base = cut(pairs.select(*by, *ids, *XYZ, "ex", "ey", "ez"))
    if inlier is None:
        pre = apply_alignment(base, align_sim3(base, by), by)
        q = pre.select(*by, *ids, *[F.col(f"a{k}").alias(k) for k in XYZ])
        thr = exact_percentile(nn_distance(q, base, by, ids), by, "distance", {"__thr": 0.5})
    else:
        thr = base.select(*by).distinct().withColumn("__thr", F.lit(float(inlier)))
    n = base.groupBy(*by).agg(F.count("*").alias("__n"))
    runs = base.join(n, by).withColumn("__it", F.explode(F.sequence(F.lit(1), F.lit(iters))))
    rank = F.row_number().over(Window.partitionBy(*by, "__it").orderBy(F.xxhash64(F.lit(seed), "__it", *ids)))
    half = runs.withColumn("__rn", rank).filter(F.col("__rn") <= F.greatest(F.lit(3), F.floor((F.col("__n") + 1) / 2)))
    models = align_sim3(half, [*by, "__it"])
    e = apply_alignment(runs, models, [*by, "__it"]).join(thr, by).filter(F.col("error") <= F.col("__thr"))
    score = e.groupBy(*by, "__it").agg(F.count("*").alias("k"), F.avg("error").alias("err"))
    best = score.groupBy(*by).agg(F.max(F.struct("k", (-F.col("err")).alias("e"), (-F.col("__it")).alias("it"))).alias("b")).select(*by, (-F.col("b.it")).alias("__it"), F.col("b.k").alias("__k"))
    chosen = e.join(best, [*by, "__it"]).filter(F.col("__k") >= 3)
    refit = align_sim3(chosen, by)
    weak = best.join(refit, by, "left_anti")
    return refit.unionByName(models.join(weak.select(*by, "__it"), [*by, "__it"]).select(*by, "r", "t", "s"))


def pca_rgb(features: DataFrame, col: str = "embedding", clip: float = 0.1, fit_on: DataFrame | None = None) -> DataFrame:
    """First three principal components scaled to 0-1 between two percentiles.

    The basis comes from ``fit_on`` (the whole table by default), so colours are stable across
    frames; each axis points so that its loadings sum to a positive number.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = lambda d: d.withColumn("__v", array_to_vector(F.transform(F.col(col), lambda x: x.cast("double"))))
    model = PCA(k=3, inputCol="__v", outputCol="__p").fit(vec(features if fit_on is None else fit_on))
    sign = [1.0 if sum(model.pc.toArray()[:, i]) >= 0 else -1.0 for i in range(3)]
    d = model.transform(vec(features)).withColumn("__a", vector_to_array("__p"))
    d = d.withColumns({f"pc{i}": F.col("__a")[i] * sign[i] for i in range(3)}).drop("__v", "__p", "__a").withColumn("__one", F.lit(1))
    for i in range(3):
        d = d.join(F.broadcast(exact_percentile(d.select("__one", f"pc{i}"), ["__one"], f"pc{i}", {f"__lo{i}": clip, f"__hi{i}": 1 - clip})), "__one")
        x = (F.col(f"pc{i}") - F.col(f"__lo{i}")) / F.greatest(F.col(f"__hi{i}") - F.col(f"__lo{i}"), F.lit(1e-8))
        d = d.withColumn("rgb"[i], F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).drop(f"__lo{i}", f"__hi{i}", f"pc{i}")
    return d.drop("__one")
