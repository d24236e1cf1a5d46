"""Neighbour search, connected components, medoids and density clusters.

Points are hashed to grid cells, so neighbours meet in an equi-join. Repeated positions are
collapsed to one row with a weight first. Nothing collects a whole group: arrays hold at most
``BLOCK`` points, and dense cells are represented by a handful of extreme points wherever those
decide the question.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerotrace.functions import geo
from aerotrace.functions import vectors as vec
from aerotrace.operators.embeddings import by_length, products, slack
from aerotrace.operators.runtime import cut, spread, written

BLOCK = 1024
MEET, STEP = 4096, 64  # rows of a block that meets another, and rows of it compared at a time

# Density cluster radius in metres and smallest cluster core.
DBSCAN_EPS, DBSCAN_MIN = 1.0, 3


def components(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None,
               node: str = "node") -> DataFrame:
    """Connected components of an undirected edge list: every node with its smallest member.

    Alternates the two star contractions (link larger neighbours to the smallest, then smaller
    ones), which finishes in a logarithmic number of rounds on long chains too. Each round is
    checkpointed and the loop ends when the edge set no longer changes.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct()
    e = cut(e)
    seen = _fingerprint(e)
    while seen[0]:
        # what a join reads is written out first, so that the many edges of one node can be split among tasks
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias(node)).distinct().withColumn("component", F.col(node))
    out = e.select(F.col("u").alias(node), F.col("v").alias("component")).unionByName(roots)
    if nodes is not None:
        out = nodes.select(node).distinct().join(out, node, "left").withColumn("component", F.coalesce("component", node))
    return out


def _fingerprint(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _sphere(lat: str, lon: str) -> dict[str, Column]:
    """Position on the globe in metres, for cell keys."""
    p, q = F.radians(lat), F.radians(lon)
    return {"__x": F.cos(p) * F.cos(q) * geo.R_EARTH, "__y": F.cos(p) * F.sin(q) * geo.R_EARTH, "__z": F.sin(p) * geo.R_EARTH}


def geo_candidates(a: DataFrame, b: DataFrame, radius: float = geo.GEO_FAR_M, by: Sequence[str] = ("mission_id",),
                   lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Pairs of rows within ``radius`` metres, with columns ``a``, ``b`` (structs) and ``distance``.

    Cells are twice the radius wide, so the ball around a point touches at most eight of them; a
    chord is never longer than the arc, so none is missed. All pairs are returned, so where many rows are at one place the result grows with their square.
    """
    by = list(by)
    size = 2.0 * radius
    cell = lambda d: d.withColumns(_sphere(lat, lon)).withColumns({f"__c{k}": F.floor(F.col(f"__{k}") / size) for k in "xyz"})
    fixes = lambda d: d.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    left = fixes(a).select(*by, F.struct(*a.columns).alias("a"), lat, lon)
    left = left.withColumns(_sphere(lat, lon))
    for k in "xyz":
        c = F.col(f"__{k}")
        left = left.withColumn(f"__c{k}", F.explode(F.array_distinct(F.array(F.floor((c - radius) / size), F.floor((c + radius) / size)))))
    left = left.drop("__x", "__y", "__z")
    right = cell(fixes(b).select(*by, F.struct(*b.columns).alias("b"), F.col(lat).alias("__la"), F.col(lon).alias("__lo"))
                 .withColumnsRenamed({"__la": lat, "__lo": lon})).drop("__x", "__y", "__z").withColumnsRenamed({lat: "__blat", lon: "__blon"})
    # rows of a crowded cell are dealt to blocks, each of which meets all rows across, so that the pairs of one place are shared by many tasks
    cells = [*by, "__cx", "__cy", "__cz"]
    blocks = cut(left.groupBy(*cells).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__n")))
    left = left.join(blocks, cells).withColumn("__b", F.pmod(F.xxhash64("a"), F.col("__n")).cast("int")).drop("__n")
    right = right.join(blocks, cells).withColumn("__b", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    d = spread(left, [*cells, "__b"]).join(spread(right, [*cells, "__b"]), [*cells, "__b"])
    d = d.withColumn("distance", geo.haversine(lat, lon, "__blat", "__blon"))
    return d.filter(F.col("distance") <= radius).select(*by, "a", "b", "distance")


def resolve_identities(tracks: DataFrame, radius: float = geo.GEO_FAR_M, min_cosine: float = 0.5,
                       by: Sequence[str] = ("mission_id",), tid: str = "tid", vector: str = "centroid") -> DataFrame:
    """Order-free identities: tracks joined by place and appearance, then components.

    Differs from the sequential assignment on purpose; ``identity`` is the smallest track id.
    """
    by = list(by)
    found = tracks.filter(F.col(tid).isNotNull() & F.col(vector).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    found = found.filter(~F.exists(vector, lambda x: x.isNull())).dropna(subset=by).select(*by, F.col(tid).alias("__tid"), F.col("lat").cast("double").alias("__lat"), F.col("lon").cast("double").alias("__lon"), F.col(vector).alias("__v")).distinct()
    found = _meeting_blocks(found, by, radius, "__lat", "__lon")
    types = dict(tracks.dtypes)

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        of = _linked_rows(pdf["__lat"].to_numpy(), pdf["__lon"].to_numpy(), list(pdf["__v"]), radius, min_cosine)
        out = pdf[by].assign(src=pdf["__tid"], dst=pdf["__tid"].to_numpy()[of])
        return out[np.arange(len(of)) != of]

    links = spread(found, [*by, "__x", "__y", "__z", "__i", "__j"]).groupBy(*by, "__x", "__y", "__z", "__i", "__j").applyInPandas(forest, ", ".join([*[f"{k} {types[k]}" for k in by], f"src {types[tid]}, dst {types[tid]}"]))
    key = lambda side: F.struct(*[F.col(k) for k in by], F.col(side).alias(tid))
    nodes = tracks.select(F.struct(*by, tid).alias("node"))
    comp = components(links.select(key("src").alias("src"), key("dst").alias("dst")), nodes=nodes)
    return comp.select("node.*", F.col("component")[tid].alias("identity"))


def _meeting_blocks(d: DataFrame, by: list[str], radius: float, lat: str, lon: str) -> DataFrame:
    """Different rows as members of groups (``by``, ``__x``, ``__y``, ``__z``, ``__i``, ``__j``) of at most some ``2 * MEET`` rows; any two rows within ``radius`` share a group.

    A row is at home in one cell of twice the radius, and a guest in those greater cells that its ball touches. Rows of a cell are dealt to blocks, and each two blocks meet.
    """
    size, names = 2.0 * radius, d.columns
    d = d.withColumns(_sphere(lat, lon))
    cells = lambda *at: F.struct(*[F.floor(c / size).alias(k) for c, k in zip(at, "xyz")])
    near = lambda k: [F.col(f"__{k}") - radius, F.col(f"__{k}") + radius]
    home = cells(F.col("__x"), F.col("__y"), F.col("__z"))
    touched = F.array_distinct(F.array(*[cells(p, q, o) for p in near("x") for q in near("y") for o in near("z")]))
    d = d.withColumn("__home", home).withColumn("__c", F.explode(F.array_distinct(F.concat(F.array("__home"), F.filter(touched, lambda c: c > F.col("__home"))))))
    d = cut(d.withColumn("__own", F.col("__c") == F.col("__home")).drop("__x", "__y", "__z", "__home"))
    blocks = lambda own: F.ceil(F.count(F.when(F.col("__own") == own, 1)) / MEET).cast("int")
    d = d.join(d.groupBy(*by, "__c").agg(blocks(True).alias("__n"), blocks(False).alias("__g")).filter("__n > 0"), [*by, "__c"])
    b = F.pmod(F.xxhash64(*names), F.when(F.col("__own"), F.col("__n")).otherwise(F.col("__g"))).cast("int")
    # blocks at home are 0 to n - 1, those of guests follow: two at home meet once (i <= j), guests meet all at home
    d = d.withColumn("__b", F.when(F.col("__own"), b).otherwise(F.col("__n") + b))
    pair = lambda i, j: F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"))
    until = F.when(F.col("__own"), F.col("__n") + F.col("__g")).otherwise(F.col("__n")) - 1
    d = d.withColumn("__p", F.explode(F.transform(F.sequence(F.lit(0), until), lambda o: pair(o, F.col("__b")))))
    return d.select(*names, F.col("__c.x").alias("__x"), F.col("__c.y").alias("__y"), F.col("__c.z").alias("__z"), F.col("__p.i").alias("__i"), F.col("__p.j").alias("__j"))


def _linked_rows(lat: np.ndarray, lon: np.ndarray, vectors: list, radius: float, least: float) -> np.ndarray:
    """For each row the first row of its component; linked are rows within ``radius`` metres whose vectors have a product of ``least`` or more.

    A row is compared only with rows that no other has reached yet, so much of a dense group costs one step a row.
    """
    of = np.arange(len(lat))
    p = np.radians(lat)
    for rows, u in by_length(vectors).values():
        left, v, open_ = np.arange(len(rows)), u, np.ones(len(rows), bool)  # rows that no component had reached lately, and which are so still
        eps = slack(u, u)
        for start in range(len(rows)):
            if of[rows[start]] != rows[start]:
                continue
            open_[np.searchsorted(left, start)] = False  # a row that none has reached is still there
            front = np.array([start])
            while len(front) and open_.any():
                now, front = front[:STEP], front[STEP:]
                with np.errstate(all="ignore"):
                    dots = u[now] @ v.T
                    i, j = np.nonzero(~(dots < least - eps) & open_)
                    a, b = rows[now[i]], rows[left[j]]
                    sp, sl = np.sin((p[b] - p[a]) / 2), np.sin(np.radians(lon[b] - lon[a]) / 2)
                    near = 2.0 * geo.R_EARTH * np.arcsin(np.minimum(1.0, np.sqrt(sp * sp + np.cos(p[a]) * np.cos(p[b]) * sl * sl))) <= radius
                    i, j = i[near], j[near]
                    # sums near the limit are taken again in the order of ``vectors.dot``; NaN is the greatest, as in SQL
                    sums = dots[i, j]
                    doubt = np.flatnonzero(~(np.abs(sums - least) > eps))
                    for k in range(0, len(doubt), 65536):
                        part = doubt[k:k + 65536]
                        sums[part] = products(u[now[i[part]]], v[j[part]])
                hit = np.unique(j[~(sums < least)])
                of[rows[left[hit]]] = rows[start]
                open_[hit] = False
                front = np.concatenate((front, left[hit]))
            if open_.sum() < 0.75 * len(left):
                left, v, open_ = left[open_], v[open_], np.ones(int(open_.sum()), bool)
    return of


# ---- medoids ------------------------------------------------------------------------------


def _distinct_points(df: DataFrame, by: list[str], order: str, lat: str, lon: str, weight: str | None = None) -> DataFrame:
    """One row per position with its weight and its first place in the order."""
    return (df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(*by, F.col(lat).alias("lat"), F.col(lon).alias("lon"))
            .agg((F.sum(weight) if weight else F.count("*")).alias("w"), F.min(order).alias("ord")))


def _arc(a: Column, b: Column) -> Column:
    """Great-circle metres between two prepared points."""
    sp, sl = F.sin((b["p"] - a["p"]) / 2), F.sin((b["l"] - a["l"]) / 2)
    return F.asin(F.sqrt(sp * sp + a["c"] * b["c"] * sl * sl)) * (2.0 * geo.R_EARTH)


def _prepared() -> Column:
    return F.struct("ord", "lat", "lon", F.col("w").cast("double").alias("w"), F.radians("lat").alias("p"), F.radians("lon").alias("l"),
                    F.cos(F.radians("lat")).alias("c"))


def _cost(p: Column, pts) -> Column:
    return F.aggregate(pts, F.lit(0.0), lambda acc, q: acc + q["w"] * _arc(p, q))


def _blocks(df: DataFrame, by: list[str], n: Column, name: str) -> DataFrame:
    """Arrays of about ``BLOCK`` prepared points."""
    d = df.withColumn("__b", F.pmod(F.xxhash64("lat", "lon"), F.greatest(F.lit(1), F.ceil(n / (BLOCK / 2)))).cast("int"))
    return d.groupBy(*by, "__b").agg(F.collect_list(_prepared()).alias(name))


def medoid(df: DataFrame, by: Sequence[str], order: str = "frame", lat: str = "lat", lon: str = "lon",
           direct: int = BLOCK, weight: str | None = None) -> DataFrame:
    """Observed position with the least summed distance to the others; the first wins ties.

    Groups of up to ``direct`` distinct positions are one small array. In larger ones a grid of at
    most 64 x 64 cell means gives every point a lower bound of its cost (the mean distance to a
    cell is never below the distance to its mean), the best bound is priced exactly, and only
    points whose bound does not exceed that price are priced in full, block against block.
    """
    by = list(by)
    pts = written(_distinct_points(df, by, order, lat, lon, weight))
    size = pts.groupBy(*by).agg(F.count("*").alias("__n"), F.sum("w").alias("n_points"))
    d = pts.join(size, by)
    small = d.filter(F.col("__n") <= direct).groupBy(*by).agg(F.collect_list(_prepared()).alias("__p"), F.first("n_points").alias("n_points"))
    priced = F.transform("__p", lambda p: F.struct(
        F.when(F.col("n_points") <= 2, 0.0).otherwise(_cost(p, F.col("__p"))).alias("cost"), p["ord"].alias("ord"), p["lat"].alias("lat"), p["lon"].alias("lon")))
    small = small.withColumn("__m", F.array_min(priced)).select(*by, "__m.lat", "__m.lon", "n_points")
    if size.filter(F.col("__n") > direct).isEmpty():
        return small
    big = d.filter(F.col("__n") > direct)
    return small.unionByName(_large_medoid(big, by).select(*by, "lat", "lon", "n_points"))


def _large_medoid(d: DataFrame, by: list[str], grid: int = 64) -> DataFrame:
    d = d.withColumns(_sphere("lat", "lon"))
    box = d.groupBy(*by).agg(*[f(k).alias(f"__{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in ("lat", "lon")],
                             *[F.avg(f"__{k}").alias(f"__m{k}") for k in "xyz"])
    d = d.join(box, by)
    cell = lambda k: F.least(F.floor((F.col(k) - F.col(f"__lo{k}")) / F.greatest(F.col(f"__hi{k}") - F.col(f"__lo{k}"), F.lit(1e-12)) * grid), F.lit(grid - 1))
    d = d.withColumns({"__i": cell("lat"), "__j": cell("lon"), **{f"__{k}": F.col(f"__{k}") - F.col(f"__m{k}") for k in "xyz"}})
    cells = d.groupBy(*by, "__i", "__j").agg(F.sum("w").cast("double").alias("w"), *[(F.sum(F.col(f"__{k}") * F.col("w")) / F.sum("w")).alias(k) for k in "xyz"])
    cells = cells.groupBy(*by).agg(F.collect_list(F.struct("w", "x", "y", "z")).alias("__cells"))

    def bound(acc, c):
        dx, dy, dz = c["x"] - F.col("__x"), c["y"] - F.col("__y"), c["z"] - F.col("__z")
        return acc + c["w"] * F.sqrt(dx * dx + dy * dy + dz * dz)

    # the cell array has at most grid * grid entries, so it travels to the points
    d = d.join(cells, by).withColumn("__lb", F.aggregate("__cells", F.lit(0.0), bound) * (1.0 - 1e-9) - 1e-3)
    d = cut(d.select(*by, "lat", "lon", "w", "ord", "n_points", "__n", "__lb"))
    best = d.groupBy(*by).agg(F.min_by(_prepared(), F.struct("__lb", "ord")).alias("__best"))
    limit = (d.join(best, by).withColumn("__q", _prepared()).groupBy(*by)
             .agg((F.sum(F.col("__q.w") * _arc(F.col("__best"), F.col("__q"))) * (1.0 + 1e-9) + 1e-3).alias("__ub")))
    cand = d.join(limit, by).filter(F.col("__lb") <= F.col("__ub"))
    n_cand = cand.groupBy(*by).agg(F.count("*").alias("__k"))
    cand = _blocks(cand.join(n_cand, by), by, F.col("__k"), "__c")
    tiles = cand.groupBy(*by).agg(F.collect_list("__b").alias("__ids"))
    blocks = _blocks(d, by, F.col("__n"), "__p").join(tiles, by).withColumn("__b", F.explode("__ids")).drop("__ids")
    priced = blocks.join(cand, [*by, "__b"]).select(*by, F.explode(F.transform("__c", lambda p: F.struct(
        p["ord"].alias("ord"), p["lat"].alias("lat"), p["lon"].alias("lon"), _cost(p, F.col("__p")).alias("part")))).alias("z"))
    total = priced.groupBy(*by, "z.ord", "z.lat", "z.lon").agg(F.sum("z.part").alias("cost"))
    out = total.groupBy(*by).agg(F.min_by(F.struct("lat", "lon"), F.struct("cost", "ord")).alias("__m"))
    return out.join(d.groupBy(*by).agg(F.first("n_points").alias("n_points")), by).select(*by, "__m.lat", "__m.lon", "n_points")


# ---- density clusters ---------------------------------------------------------------------


def density_clusters(df: DataFrame, by: Sequence[str], order: str = "frame", lat: str = "lat", lon: str = "lon",
                     eps: float = DBSCAN_EPS, min_points: int = DBSCAN_MIN) -> DataFrame:
    """DBSCAN per group over distinct positions: ``cluster`` is the first core place, NULL for noise.

    Cells are ``eps`` across their diagonal: a cell with ``min_points`` fixes holds core points
    only and is connected in itself, so only thin cells are compared point by point.
    """
    by = list(by)
    pts = _distinct_points(df, by, order, lat, lon)
    mean = pts.groupBy(*by).agg((F.sum(F.col("lat") * F.col("w")) / F.sum("w")).alias("__la0"), (F.sum(F.col("lon") * F.col("w")) / F.sum("w")).alias("__lo0"))
    side = eps / math.sqrt(2.0)
    pts = pts.join(mean, by).withColumn("__xy", geo.local_xy("lat", "lon", "__la0", "__lo0"))
    pts = pts.select(*by, "lat", "lon", "w", "ord", F.col("__xy.x").alias("x"), F.col("__xy.y").alias("y"))
    pts = pts.withColumns({"ci": F.floor(F.col("x") / side), "cj": F.floor(F.col("y") / side)})
    ckey = [*by, "ci", "cj"]
    heavy = pts.groupBy(*ckey).agg(F.sum("w").alias("__cw"))
    pts = cut(pts.join(heavy, ckey).withColumn("dense", F.col("__cw") >= min_points).drop("__cw"))

    thin = pts.filter("not dense").select(*by, F.struct("ord", "lat", "lon").alias("sord"), F.col("x").alias("sx"), F.col("y").alias("sy"), "ci", "cj")
    thin = thin.withColumn("__di", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("__dj", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    thin = thin.withColumns({"ci": F.col("ci") + F.col("__di"), "cj": F.col("cj") + F.col("__dj")}).drop("__di", "__dj")
    sq = lambda ax, ay, bx, by_: (ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)
    near = sq(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")) <= eps * eps
    counts = thin.join(pts.select(*ckey, "x", "y", "w"), ckey).filter(near).groupBy(*by, "sord").agg(F.sum("w").alias("__nb"))
    pts = pts.join(counts.select(*by, "sord.*", "__nb"), [*by, "ord", "lat", "lon"], "left")
    pts = cut(pts.withColumn("core", F.col("dense") | (F.coalesce("__nb", F.lit(0)) >= min_points)).drop("__nb", "dense"))

    core = pts.filter("core")
    p = F.struct("x", "y")
    reps = [f(p, k) for f in (F.min_by, F.max_by) for k in (F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y"))]
    cells = core.groupBy(*ckey).agg(F.min("ord").alias("first"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
                                    F.max("y").alias("y1"), F.count("*").alias("n"), F.array(*reps).alias("reps"))
    box = ["x0", "x1", "y0", "y1", "n", "reps"]
    a = cells.select(*ckey, F.struct(*box).alias("a"))
    half = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in half])
    b = cells.select(*by, "ci", "cj", F.struct(*box).alias("b"), F.explode(offs).alias("o"))
    b = b.select(*by, (F.col("ci") - F.col("o.i")).alias("ci"), (F.col("cj") - F.col("o.j")).alias("cj"), "b", F.col("ci").alias("bi"), F.col("cj").alias("bj"))
    pairs = a.join(b, ckey)
    gap = lambda lo, hi: F.greatest(F.lit(0.0), F.col(f"b.{lo}") - F.col(f"a.{hi}"), F.col(f"a.{lo}") - F.col(f"b.{hi}"))
    pairs = pairs.filter(gap("x0", "x1") * gap("x0", "x1") + gap("y0", "y1") * gap("y0", "y1") <= eps * eps)
    joined = F.exists(F.col("a.reps"), lambda u: F.exists(F.col("b.reps"), lambda v: sq(u["x"], u["y"], v["x"], v["y"]) <= eps * eps))
    pairs = cut(pairs.withColumn("joined", joined))
    sure = pairs.filter("joined").select(*ckey, "bi", "bj")
    # up to three points are all among the extremes, so those pairs are settled
    open_ = pairs.filter(~F.col("joined") & ((F.col("a.n") > 3) | (F.col("b.n") > 3))).select(*ckey, "bi", "bj", F.col("a.n").alias("an"), F.col("b.n").alias("bn"))
    arr = lambda n, s: (core.withColumn("__n", F.lit(1)).select(*ckey, F.pmod(F.xxhash64("x", "y"), F.lit(2 ** 31 - 1)).alias("h"), p.alias(s)))
    left = open_.join(arr("an", "pa"), ckey).withColumn("k", F.pmod("h", F.ceil(F.col("an") / BLOCK))).groupBy(*ckey, "bi", "bj", "k").agg(F.collect_list("pa").alias("pa"))
    right = open_.select(*by, "ci", "cj", "bi", "bj", "bn").join(arr("bn", "pb").withColumnsRenamed({"ci": "bi", "cj": "bj"}), [*by, "bi", "bj"])
    right = right.withColumn("k2", F.pmod("h", F.ceil(F.col("bn") / BLOCK))).groupBy(*ckey, "bi", "bj", "k2").agg(F.collect_list("pb").alias("pb"))
    proved = left.join(right, [*ckey, "bi", "bj"]).filter(F.exists("pa", lambda u: F.exists("pb", lambda v: sq(u["x"], u["y"], v["x"], v["y"]) <= eps * eps)))
    edges = sure.unionByName(proved.select(*ckey, "bi", "bj")).distinct()
    edges = edges.select(F.struct(*ckey).alias("src"), F.struct(*by, F.col("bi").alias("ci"), F.col("bj").alias("cj")).alias("dst"))
    comp = components(edges, nodes=cells.select(F.struct(*ckey).alias("node")))
    comp = comp.select("node.*", "component")
    named = comp.join(cells.select(*ckey, "first"), ckey)
    label = named.groupBy("component").agg(F.min("first").alias("cluster"))
    cellc = comp.join(label, "component").select(*ckey, "cluster")

    core_l = core.join(cellc, ckey)
    border = pts.filter("not core").select(*by, F.struct("ord", "lat", "lon").alias("sord"), F.col("x").alias("sx"), F.col("y").alias("sy"), "ci", "cj")
    border = border.withColumn("__di", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("__dj", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    border = border.withColumns({"ci": F.col("ci") + F.col("__di"), "cj": F.col("cj") + F.col("__dj")}).drop("__di", "__dj")
    border = border.join(core_l.select(*ckey, "x", "y", "cluster"), ckey).filter(near).groupBy(*by, "sord").agg(F.min("cluster").alias("cluster"))
    rest = pts.filter("not core").join(border.select(*by, "sord.*", "cluster"), [*by, "ord", "lat", "lon"], "left")
    cols = [*by, "lat", "lon", "w", "ord", "core", "cluster"]
    return core_l.select(*cols).unionByName(rest.select(*cols))


def density_medoid(df: DataFrame, by: Sequence[str], order: str = "frame", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Medoid of the largest density cluster, of all fixes where there is no cluster."""
    by = list(by)
    c = cut(density_clusters(df, by, order, lat, lon))
    sizes = c.filter(F.col("cluster").isNotNull()).groupBy(*by, "cluster").agg(F.sum("w").alias("n"))
    top = sizes.groupBy(*by).agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("__top"))
    kept = c.join(top, by, "left").filter(F.col("__top").isNull() | (F.col("cluster") == F.col("__top")))
    return medoid(kept, by, "ord", weight="w")
