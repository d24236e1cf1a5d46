"""Appearance vectors: gallery separation, view selection, identity batches and hard pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerotrace.functions import geo
from aerotrace.functions import vectors as vec
from aerotrace.operators import ordered
from aerotrace.operators.runtime import cut, spread

# Fixed values of the gallery comparison.
TOP_DIMS, SUPPORT_TOP, SPLITS, EPS = 16, 3, 5, 1e-8
W_SEPARATION, W_OVERLAP, W_SUPPORT = 0.35, 0.20, 0.45
RATIO_MAX, SUPPORT_MIN, VIEW_WEIGHT = 3.5, 0.78, 0.35
VISUAL_WEIGHT, GEO_WEIGHT = 0.5, 0.5
VIEW_BLOCK = 8192  # views of a block that meets another


def galleries(obs: DataFrame, keys: Sequence[str], col: str = "embedding", order: str = "frame") -> DataFrame:
    """One row per gallery with its vectors in frame order; galleries hold at most 45 entries."""
    g = F.array_sort(F.collect_list(F.struct(order, F.col(col).alias("e"))))
    return obs.groupBy(*keys).agg(F.transform(g, lambda x: x["e"]).alias("gallery"))


def separations(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Separation scores and supports of a batch of gallery pairs, arrays of (pair, entry, dimension).

    The differences over all pairs of entries have mean mean(a) - mean(b) and variance var(a) + var(b), so they are never
    formed. Dimensions are ranked by signal over noise and by shared magnitude; the best ``TOP_DIMS`` count.
    """
    (mean_a, mean_b), (var_a, var_b) = (a.mean(1), b.mean(1)), (a.var(1), b.var(1))
    gap = np.abs(mean_a - mean_b)
    relative = lambda x: x / (x.max(1, keepdims=True) + EPS)
    signal = gap / (np.sqrt(var_a + var_b) + EPS)
    weight = 0.45 * relative(signal) + 0.55 * relative(np.abs(a).mean(1) * np.abs(b).mean(1))
    top = np.argsort(weight, axis=1)[:, ::-1][:, :TOP_DIMS]
    apart = 1.0 - np.exp(-0.5 * (gap / (np.sqrt(var_a) + np.sqrt(var_b) + EPS)) ** 2)
    chosen = lambda x: np.take_along_axis(x, top, 1)
    unit = lambda x: x / (np.linalg.norm(x, axis=2, keepdims=True) + EPS)
    cosine = unit(np.take_along_axis(a, top[:, None, :], 2)) @ unit(np.take_along_axis(b, top[:, None, :], 2)).transpose(0, 2, 1)
    closest = [np.sort(c, axis=2)[:, :, -SUPPORT_TOP:] for c in (cosine, cosine.transpose(0, 2, 1))]
    support = sum((c * c).mean((1, 2)) for c in closest) / 2.0
    return W_SEPARATION * np.tanh(chosen(signal)).mean(1) + W_OVERLAP * chosen(apart).mean(1) + W_SUPPORT * (1.0 - support), support


def _stack(x) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in x]) if len(x) else np.empty((0, 0))


def _pair(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    if not len(a) or not len(b):
        return 0.0, 0.0
    score, support = separations(a[None], b[None])
    return float(score[0]), float(support[0])


def half_split_score(g: np.ndarray) -> float:
    """Mean separation of ``SPLITS`` seeded halvings of one gallery, all halvings in one batch."""
    if len(g) < 2:
        return 0.0
    draw = np.random.default_rng(42)
    order = np.stack([draw.permutation(len(g)) for _ in range(SPLITS)])
    left, right = np.split(g[order], [len(g) // 2], axis=1)
    return float(separations(left, right)[0].mean())


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("support", T.DoubleType())]))
def separation(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Separation score and support of two gallery columns."""
    return pd.DataFrame([_pair(_stack(x), _stack(y)) for x, y in zip(a, b)], columns=["score", "support"])


@F.pandas_udf(T.DoubleType())
def self_baseline(g: pd.Series) -> pd.Series:
    return pd.Series([half_split_score(_stack(x)) for x in g])


def compare_galleries(pairs: DataFrame, mode: str = "fused") -> DataFrame:
    """Match decision of gallery pairs; ``mode`` is ``geo``, ``visual`` or ``fused``.

    ``pairs`` has ``distance`` (NULL without fixes) and, unless the mode is geo, ``gallery_a``,
    ``gallery_b``, ``centroid_a`` and ``centroid_b``.
    """
    gs = F.when(F.col("distance").isNull(), 0.0).otherwise(geo.geo_score("distance"))
    if mode == "geo":
        return pairs.withColumn("score", gs).withColumn("is_match", F.col("score") > 0.5)
    d = pairs.withColumn("__s", separation("gallery_a", "gallery_b"))
    d = d.withColumn("__b", F.greatest(self_baseline("gallery_a"), self_baseline("gallery_b")))
    gate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("__s.support") - 0.55) / 0.25))
    base = F.col("__b") + VIEW_WEIGHT * gate * (1.0 - vec.dot("centroid_a", "centroid_b"))
    d = d.withColumn("ratio", F.col("__s.score") / (base + EPS)).withColumn("support", F.col("__s.support"))
    visual = (F.col("ratio") < RATIO_MAX) & (F.col("support") > SUPPORT_MIN)
    if mode == "visual":
        return d.withColumn("is_match", visual).drop("__s", "__b")
    vs = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("ratio") / RATIO_MAX))
    d = d.withColumn("score", VISUAL_WEIGHT * vs + GEO_WEIGHT * gs)
    far = F.coalesce(F.col("distance") > geo.GEO_FAR_M, F.lit(False))
    return d.withColumn("is_match", ~far & (F.col("score") > 0.5) & visual).drop("__s", "__b")


def by_length(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and rows of the vectors of each length; only those of one length have products."""
    found: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        found.setdefault(len(v), []).append(i)
    return {d: (np.array(at), np.array([vectors[i] for i in at], float).reshape(len(at), d)) for d, at in found.items()}


def products(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Product of each row of ``u`` with the same row of ``v``, summed in the order of ``vectors.dot``."""
    total = np.zeros(len(u))
    with np.errstate(all="ignore"):
        for k in range(u.shape[1]):
            total += u[:, k] * v[:, k]
    return total


def slack(u: np.ndarray, v: np.ndarray) -> float:
    """More than two ways of summing a product of rows of ``u`` and ``v`` can differ; NaN if some are not finite."""
    with np.errstate(all="ignore"):
        top = np.abs(u).max(initial=0.0) * np.abs(v).max(initial=0.0) * u.shape[1]
        return 1e-12 * (top + 1e-300) if np.isfinite(top) else np.nan


def similarity_range(own: list, own_ids: np.ndarray, across: list, across_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest and smallest product of each vector with those of other ids across, and 0.

    A matrix product finds those that may be the extremes, which are summed again in the order of ``vectors.dot``; NaN is the greatest, as in SQL.
    """
    hi, lo = np.zeros(len(own)), np.zeros(len(own))
    a, b = by_length(own), by_length(across)
    for d in a.keys() & b.keys():
        (rows, u), (cols, v) = a[d], b[d]
        v, first, of = np.unique(v, axis=0, return_index=True, return_inverse=True)  # copies have equal products
        of, ids = of.reshape(-1), across_ids[cols]
        alone = ids[first].copy()  # the id of a vector, where all its copies have it
        shared = np.zeros(len(v), bool)
        shared[of[ids != alone[of]]] = True
        for r in range(0, len(rows), 512):
            at, some = rows[r:r + 512], u[r:r + 512]
            eps = slack(some, v)
            with np.errstate(all="ignore"):
                sums = some @ v.T
            skip = (own_ids[at][:, None] == alone[None]) & ~shared[None]
            top, low = np.where(skip, -np.inf, sums), np.where(skip, np.inf, sums)
            with np.errstate(all="ignore"):
                i, j = np.nonzero(~skip & ~((top < top.max(1)[:, None] - eps) & (low > low.min(1)[:, None] + eps)))
            for k in range(0, len(i), 65536):
                x, y = i[k:k + 65536], j[k:k + 65536]
                exact = products(some[x], v[y])
                np.maximum.at(hi, at[x], exact)
                np.fmin.at(lo, at[x], exact)
    return hi, lo


def reference_view(views: DataFrame, strategy: str = "saddle_balanced", by: Sequence[str] = ("scene",), order: str = "view",
                   col: str = "embedding") -> DataFrame:
    """View a scene is anchored to.

    The mean similarity of a view to the others follows from the sum of all unit vectors, so the
    balanced strategy needs no pairs. The range strategy compares blocks of views.
    """
    by = list(by)
    pos = views.groupBy(*by).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    if strategy == "first":
        return pos.select(*by, F.col("__first").alias("reference"))
    if strategy == "middle":
        seg = F.floor(F.col(order) / 4096)
        d = ordered.running_sum(views.select(*by, order), by, [order], seg, F.lit(1), "__k").join(pos, by)
        return d.filter(F.col("__k") == F.floor(F.col("__n") / 2) + 1).select(*by, F.col(order).alias("reference"))
    u = views.withColumn("__len", vec.norm(col))  # a column of its own, or each element would take the norm again
    u = u.withColumn("__u", F.when(F.col("__len") >= 0.0, F.transform(col, lambda x: x.cast("double") / F.col("__len")))).select(*by, order, "__len", "__u")
    single = pos.filter("__n = 1").select(*by, F.col("__first").alias("reference"))
    if strategy == "saddle_balanced":
        total = vec.by_element(u, by, "__u", F.sum, "__sum").join(pos.select(*by, "__n").filter("__n > 1"), by)
        d, dim = u.join(total, by), F.size("__u")
        mean = F.aggregate("__u", F.lit(0.0), lambda a, x: a + x) / dim
        var = F.aggregate("__u", F.lit(0.0), lambda a, x: a + x * x)
        d = d.withColumns({"__sim": (vec.dot("__u", "__sum") - 1.0) / (F.col("__n") - 1), "__mean": mean, "__sq": var})
        d = d.withColumn("__var", (F.col("__sq") - dim * F.col("__mean") * F.col("__mean")) / (dim - 1))
        names = ["__sim", "__len", "__var"]
        ext = d.groupBy(*by).agg(*[f(k).alias(f"{k}_{n}") for k in names for n, f in (("lo", F.min), ("hi", F.max))])
        d = d.join(ext, by)
        score = [F.abs((F.col(k) - F.col(f"{k}_lo")) / (F.col(f"{k}_hi") - F.col(f"{k}_lo") + EPS) - 0.5) for k in names]
        best = d.groupBy(*by).agg(F.min_by(order, F.struct((score[0] + score[1] + score[2]).alias("s"), order)).alias("reference"))
        return best.unionByName(single)
    if strategy != "saddle_sim_range":
        raise ValueError(strategy)
    side = F.greatest(F.lit(1), F.ceil(F.col("__n") / VIEW_BLOCK)).cast("int")
    n = cut(u).join(pos.filter("__n > 1").select(*by, side.alias("__nb")), by)
    n = n.select(*by, order, "__u", "__nb", F.pmod(F.xxhash64(order), F.col("__nb")).cast("int").alias("__b"))
    to = F.sequence(F.lit(0), F.col("__nb") - 1)
    valid = F.col("__u").isNotNull() & F.col(order).isNotNull()
    without, n = n.filter(~valid).select(*by, order, F.lit(0.0).alias("hi"), F.lit(0.0).alias("lo")), n.filter(valid)
    # each view once as a row of the table and once as a column, for every block across
    met = n.select(*by, order, "__u", F.lit(True).alias("__own"), F.col("__b").alias("__i"), F.explode(to).alias("__j"))
    met = met.unionByName(n.select(*by, order, "__u", F.lit(False).alias("__own"), F.explode(to).alias("__i"), F.col("__b").alias("__j")))
    types = dict(views.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in (*by, order)], "hi double, lo double"])

    def extremes(pdf: pd.DataFrame) -> pd.DataFrame:
        own, across = pdf[pdf["__own"]].reset_index(drop=True), pdf[~pdf["__own"]].reset_index(drop=True)
        hi, lo = similarity_range(list(own["__u"]), own[order].to_numpy(), list(across["__u"]), across[order].to_numpy())
        return own[[*by, order]].assign(hi=hi, lo=lo)

    q = spread(met, [*by, "__i", "__j"]).groupBy(*by, "__i", "__j").applyInPandas(extremes, schema).unionByName(without)
    # the zeroed diagonal takes part in both extremes
    q = q.groupBy(*by, order).agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    best = q.groupBy(*by).agg(F.min_by(order, F.struct((F.col("lo") - F.col("hi")).alias("s"), order)).alias("reference"))
    return best.unionByName(single)


def reorder_by_reference(views: DataFrame, reference: DataFrame, by: Sequence[str] = ("scene",), order: str = "view") -> DataFrame:
    """Sort key that puts the reference view first and keeps the others in order."""
    d = views.join(reference, list(by))
    return d.withColumn("view_order", F.struct((F.col(order) != F.col("reference")).alias("rest"), order))


def pk_batches(images: DataFrame, p: int, k: int, seed: int = 0, pid: str = "pid", img: str = "img") -> DataFrame:
    """One epoch of batches of ``p`` identities with ``k`` images each.

    Identities need two images. Order and choice follow seeded hashes; identities short of ``k``
    images draw with replacement. The last, incomplete batch is left out.
    """
    n = images.groupBy(pid).agg(F.count("*").alias("__n")).filter("__n >= 2")
    ids = n.withColumn("__h", F.xxhash64(F.lit(seed), pid)).withColumn("__one", F.lit(1))
    ids = ordered.running_sum(ids, ["__one"], ["__h", pid], F.shiftright("__h", 40), F.lit(1), "__rank")
    ids = ids.withColumn("batch", F.floor((F.col("__rank") - 1) / p)).select(pid, "__n", "batch")
    # identities are few next to images, and the batch count is one number
    whole = ids.groupBy("batch").agg(F.count("*").alias("__c")).filter(F.col("__c") == p).select("batch")
    ids = ids.join(whole, "batch")
    w = Window.partitionBy(pid).orderBy(F.xxhash64(F.lit(seed), pid, img), img)
    ranked = images.join(ids, pid).withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k)
    slots = ids.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(k))))
    pick = F.when(F.col("__n") >= k, F.col("slot")).otherwise(F.pmod(F.xxhash64(F.lit(seed), pid, "slot"), F.col("__n")) + 1)
    slots = slots.withColumn("__rn", pick.cast("int")).select(pid, "batch", "slot", "__rn")
    return slots.join(ranked.select(pid, img, "__rn"), [pid, "__rn"]).select("batch", pid, "slot", img)


def hard_pairs(emb: DataFrame, by: str = "batch", pid: str = "pid", img: str = "img", col: str = "embedding") -> DataFrame:
    """Hardest positive and negative distance of each anchor within its batch (p * k rows).

    ``active`` marks anchors whose soft margin still pushes; anchors without a positive are NULL.
    """
    types = dict(emb.dtypes)
    schema = f"{by} {types[by]}, {img} {types[img]}, hard_pos double, hard_neg double, active boolean"

    def per_batch(pdf):
        x = _stack(pdf[col])
        y = pdf[pid].to_numpy()
        sq = (x * x).sum(1)
        dist = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0.0))
        same = y[:, None] == y[None, :]
        pos = same & ~np.eye(len(y), dtype=bool)
        hp = np.where(pos, dist, -np.inf).max(1)
        hn = np.where(~same, dist, np.inf).min(1)
        has = pos.any(1)
        push = np.log1p(np.exp(np.clip(hp - hn, -50, 50)))
        return pd.DataFrame({by: pdf[by], img: pdf[img], "hard_pos": np.where(has, hp, np.nan), "hard_neg": np.where(np.isinf(hn), np.nan, hn),
                             "active": [bool(v > 1e-6) if h else None for v, h in zip(push, has)]})

    out = emb.groupBy(by).applyInPandas(per_batch, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("hard_pos", "hard_neg")})
