"""Identity records: galleries, summaries over buffers, notices and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerotrace.functions import geo
from aerotrace.functions import vectors as vec
from aerotrace.operators import clouds, ordered
from aerotrace.operators.ranks import exact_percentile

# Slots per gallery slice, and the smallest usable gallery.
RECENT, TOP_CONF, TOP_SHARP, MIN_GALLERY = 15, 15, 15, 2

TRACK_KEYS = ("mission_id", "tid")


def _ranked(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """First ``n`` rows per key. One rank per pass lets Spark cut each task to ``n`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def _slices(df: DataFrame, keys, order: str, recent=RECENT, conf=TOP_CONF, sharp=TOP_SHARP):
    o = F.col(order).asc()
    return (_ranked(df, keys, recent, F.col(order).desc()), _ranked(df, keys, conf, F.col("conf").desc(), o),
            _ranked(df, keys, sharp, F.col("sharpness").desc(), o))


def build_gallery(obs: DataFrame, keys: Sequence[str] = TRACK_KEYS, recent: int = RECENT, conf: int = TOP_CONF,
                  sharp: int = TOP_SHARP) -> DataFrame:
    """Newest, most confident and sharpest observations of each track, one per frame."""
    keys = list(keys)
    a, b, c = _slices(obs, keys, "frame", recent, conf, sharp)
    u = a.withColumn("__s", F.lit(0)).unionByName(b.withColumn("__s", F.lit(1))).unionByName(c.withColumn("__s", F.lit(2)))
    g = u.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "frame").orderBy("__s"))).filter("__rn = 1")
    size = F.count("*").over(Window.partitionBy(*keys))
    return g.withColumn("__size", size).filter(F.col("__size") >= MIN_GALLERY).drop("__rn", "__s", "__size")


def merge_gallery(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("mission_id", "gid")) -> DataFrame:
    """Gallery after a merge: newest of the new side, best of both. Repeats across slices stay."""
    keys = list(keys)
    _, oc, os_ = _slices(old, keys, "frame")
    nr, nc, ns = _slices(new, keys, "frame")
    first = lambda d, side: d.withColumn("__side", F.lit(side))
    pick = lambda a, b, col, n: _ranked(first(a, 0).unionByName(first(b, 1)), keys, n, F.col(col).desc(), F.col("__side").asc(), F.col("frame").asc()).drop("__side")
    return (nr.withColumn("slice", F.lit("recent")).unionByName(pick(oc, nc, "conf", TOP_CONF).withColumn("slice", F.lit("conf")))
            .unionByName(pick(os_, ns, "sharpness", TOP_SHARP).withColumn("slice", F.lit("sharp"))))


def representative(obs: DataFrame, keys: Sequence[str] = TRACK_KEYS, cols: Sequence[str] = ("frame", "sharpness")) -> DataFrame:
    """The sharpest observation; the earliest frame among equals."""
    return obs.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("sharpness", -F.col("frame"))).alias("__r")).select(*keys, "__r.*")


def gid_summary(buffers: DataFrame, keys: Sequence[str] = ("mission_id", "gid")) -> DataFrame:
    """Flat record of each identity: newest known values, spans and bests over every buffer."""
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("update_no")))
    return buffers.groupBy(*keys).agg(
        F.max_by("event", "update_no").alias("event"), F.count("*").alias("updates"), newest("tid").alias("tid"),
        F.coalesce(newest("cumulative_gallery"), F.lit(0)).alias("gallery_size"), F.max("best_conf").alias("best_conf"),
        F.max("best_sharpness").alias("best_sharpness"), F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"))


def gid_summary_asof(buffers: DataFrame, k: int | None = None, keys: Sequence[str] = ("mission_id", "gid")) -> DataFrame:
    """Record as it stood at update ``k``, or at every update when ``k`` is not given."""
    if k is not None:
        return gid_summary(buffers.filter(F.col("update_no") <= k), keys)
    seg = F.floor(F.col("update_no") / 1024)
    # running min and max per segment plus a carry of the segment extremes
    by, ks = list(keys), [*keys, "__seg"]
    d = buffers
    for c in ("tid", "cumulative_gallery"):  # the newest known value up to each update
        d = ordered.carry(d, by, ["update_no"], seg, F.col(c), prev=f"__known_{c}")
    d = d.withColumn("__seg", seg)
    w = Window.partitionBy(*ks).orderBy("update_no").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*by).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    spec = {"best_conf": F.max, "best_sharpness": F.max, "first_frame": F.min, "last_frame": F.max}
    seg_ext = d.groupBy(*ks).agg(*[fn(c).alias(f"__s_{c}") for c, fn in spec.items()], F.count("*").alias("__s_n"))
    seg_ext = seg_ext.select(*ks, *[fn(f"__s_{c}").over(up).alias(f"__c_{c}") for c, fn in spec.items()],
                             F.coalesce(F.sum("__s_n").over(up), F.lit(0)).alias("__c_n"))
    d = d.join(seg_ext, ks, "left")
    run = {c: (F.greatest if fn is F.max else F.least)(fn(c).over(w), F.col(f"__c_{c}")) for c, fn in spec.items()}
    return d.select(*by, "update_no", "event", (F.count("*").over(w) + F.col("__c_n")).alias("updates"), F.col("__known_tid").alias("tid"),
                    F.coalesce("__known_cumulative_gallery", F.lit(0)).alias("gallery_size"), *[v.alias(c) for c, v in run.items()])


def gid_notices(gids: DataFrame, by: Sequence[str] = ("mission_id", "gid"), order: str = "seq") -> DataFrame:
    """One notice per real change of a record: found first, seen again on each new update count."""
    d = ordered.previous(gids, by, [order], F.floor(F.col(order) / 4096), ["updates"], "__last")
    d = d.filter(F.col("__last").isNull() | (F.col("__last")["updates"] != F.col("updates")))
    first = F.col("__last").isNull()
    return d.withColumns({
        "kind": F.when(first, "found").otherwise("again"),
        "text": F.concat(F.lit("Casualty "), F.col("gid").cast("string"), F.when(first, " found").otherwise(" seen again"))}).drop("__last")


def gid_crops(gids: DataFrame, crops: DataFrame, keys: Sequence[str] = ("mission_id", "gid")) -> DataFrame:
    """Crop files of each identity in name order, one row per file."""
    d = gids.join(crops, list(keys))
    return d.withColumn("crop_no", F.row_number().over(Window.partitionBy(*keys).orderBy("crop")))


def median_position(df: DataFrame, by: Sequence[str] = TRACK_KEYS) -> DataFrame:
    """Median latitude and median longitude, each on its own."""
    by = list(by)
    la = exact_percentile(df, by, "lat", {"lat": 0.5})
    return la.join(exact_percentile(df, by, "lon", {"lon": 0.5}), by)


def centroid(df: DataFrame, by: Sequence[str] = TRACK_KEYS, col: str = "embedding") -> DataFrame:
    """Unit-length mean vector; NULL when the mean vanishes."""
    return vec.by_element(df, by, col, F.avg, "__m").withColumn("centroid", vec.l2norm("__m")).drop("__m")


def rank_by_distance(gids: DataFrame, probes: DataFrame, probe_key: str = "probe_id", gid: str = "gid") -> DataFrame:
    """All identities by distance from each probe point, with their ``rank`` from 1; unplaced ones come last.

    The result has a row for every probe and identity; ``nearest_gid`` finds the first one without them. Probes are copied to every block of identities, and
    ranks are made over sorted ranges, so no task holds all identities of a probe.
    """
    blocks = int(gids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = gids.withColumn("__b", F.pmod(F.xxhash64(gid), F.lit(blocks)).cast("int"))
    p = probes.select(F.col(probe_key), F.col("lat").alias("__plat"), F.col("lon").alias("__plon"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__b"))
    d = g.join(p, "__b").withColumn("distance", geo.haversine("lat", "lon", F.col("__plat"), F.col("__plon"), geo.R_EARTH_MEAN))
    ranked = ordered.rank_over(d, [probe_key], [F.col("distance").asc_nulls_last(), F.col(gid).asc()], "rank")
    return ranked.select(probe_key, *gids.columns, "distance", F.col("rank").cast("int").alias("rank"))


def _on_sphere(d: DataFrame) -> DataFrame:
    """Rows with a place, and that place in metres from the centre of the Earth; nearer on the ground is nearer in space."""
    placed = d.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    la, lo, radius = F.radians("lat"), F.radians("lon"), F.lit(geo.R_EARTH_MEAN)
    return placed.withColumns({"__all": F.lit(0), "x": radius * F.cos(la) * F.cos(lo), "y": radius * F.cos(la) * F.sin(lo), "z": radius * F.sin(la)})


def nearest_gid(gids: DataFrame, probes: DataFrame, probe_key: str = "probe_id", gid: str = "gid", cell: float = 2.5) -> DataFrame:
    """Closest placed identity of each probe, as ``gid`` and ``distance`` in metres; the smaller number among equals.

    Identities lie in cells ``cell`` metres wide. A hierarchy of boxes around the cells tells which of them can hold the nearest identity of the probes of a cell,
    however far away; only those are met. Identities at one place are met as one, in arrays of about ``clouds.BLOCK`` places that go to the cells of probes, so a probe is not
    copied for each of them: it is reduced to its nearest identity where it meets an array. A probe without a place, or without any placed identity, has no row.
    """
    g = _on_sphere(gids.select(F.col(gid).alias("gid"), "lat", "lon").groupBy("lat", "lon").agg(F.min(F.struct("gid")).alias("__g")).select("__g.gid", "lat", "lon"))
    p = _on_sphere(probes.select(probe_key, "lat", "lon"))
    pairs = clouds.nearest_cells(p, g, ["__all"], cell)
    at = lambda d, c: d.withColumns({f"{c}{k}": F.floor(F.col(k) / cell).cast("bigint") for k in "xyz"})
    own, far = ["__all", "qx", "qy", "qz"], ["__all", "cx", "cy", "cz"]
    placed = at(g, "c")
    blocks = F.ceil(F.count("*").over(Window.partitionBy(*far)) / clouds.BLOCK)
    packed = placed.withColumn("__b", F.pmod(F.xxhash64("lat", "lon"), blocks)).groupBy(*far, "__b").agg(F.collect_list(F.struct("lat", "lon", "gid", *"xyz")).alias("__r"))
    # Spark takes an array for a few bytes, so these joins must never be chosen for a broadcast
    met = at(p, "q").withColumnsRenamed({"lat": "__plat", "lon": "__plon"}).hint("merge").join(pairs.hint("merge").join(packed, far).select(*own, "__r"), own)
    # the straight line is cheaper than the arc and ranks alike but for its rounding, so arcs are needed only of places within a micrometre of the nearest
    line = lambda i: F.sqrt(sum(((i[k] - F.col(k)) * (i[k] - F.col(k)) for k in "yz"), (i["x"] - F.col("x")) * (i["x"] - F.col("x"))))
    away = lambda i: F.struct(geo.haversine(i["lat"], i["lon"], F.col("__plat"), F.col("__plon"), geo.R_EARTH_MEAN).alias("distance"), i["gid"].alias("gid"))
    least = F.array_min(F.transform("__r", line)) + 1e-6
    d = met.select(probe_key, F.transform(F.array(least), lambda m: F.array_min(F.transform(F.filter("__r", lambda i: line(i) <= m), away)))[0].alias("__n"))
    return d.groupBy(probe_key).agg(F.min("__n").alias("__n")).select(probe_key, "__n.gid", "__n.distance")


def gid_record(headers: DataFrame, buffers: DataFrame, entries: DataFrame, files: DataFrame | None = None, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Full record of each identity from the three tables of the record reader, one row per header.

    To the newest values, spans and bests over all buffers come the final position, the clock values of the newest buffer, and counts. Without
    a buffer the event is "new" and the gallery empty. ``files`` (keys, ``name``) lists the files next to the record: crops are counted, and ``representative`` changes with
    every update. The track itself, which may be long, is ``gid_track``.
    """
    keys = list(keys)
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("buffer_no")))
    b = buffers.groupBy(*keys).agg(
        F.max_by("event", "buffer_no").alias("event"), F.count("*").alias("updates"), newest("tid").alias("tid"), newest("cumulative_gallery").alias("gallery_size"),
        F.max("best_confidence").alias("best_conf"), F.max("best_sharpness").alias("best_sharpness"), F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"),
        newest("mission_timestamp").alias("mission_timestamp"), newest("ros_assignment_time").alias("ros_time"))
    e = entries.groupBy(*keys).agg(F.count("*").alias("entries"))
    h = headers.select(*keys, "gid", "created", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("samples").alias("gps_samples"))
    d = h.join(b, keys, "left").join(e, keys, "left").withColumns({"event": F.coalesce("event", F.lit("new"))} | {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("updates", "gallery_size", "entries")})
    if files is None:
        return d
    crop = F.col("name").startswith("crop_frame_") & F.col("name").endswith(".jpg")
    f = files.distinct().groupBy(*keys).agg(F.count_if(crop).alias("crops"), F.max(F.col("name") == "representative.jpg").alias("__rep"))
    folder = F.concat(F.lit("gid_"), F.col("gid").cast("string"), F.lit("/representative.jpg?v="), F.col("updates").cast("string"))
    return d.join(f, keys, "left").withColumns({"crops": F.coalesce("crops", F.lit(0).cast("bigint")), "representative": F.when(F.col("__rep"), folder)}).drop("__rep")


def gid_track(entries: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Entries of all buffers of an identity as one track, numbered by ``track_no`` from 1. A buffer holds at most a gallery."""
    return ordered.running_sum(entries, list(keys), ["buffer_no", "pos"], F.floor(F.col("buffer_no") / 64), F.lit(1), "track_no")


def append_new_crops(new: DataFrame, existing: DataFrame, keys: Sequence[str] = ("mission_id", "gid", "frame", "conf", "sharpness")) -> DataFrame:
    """Gallery entries whose crop file does not exist yet; names hold conf to two digits and whole sharpness."""
    def named(d):
        return d.withColumns({"__c": F.format_string("%.2f", "conf"), "__s": F.col("sharpness").cast("bigint")})
    ids = [k for k in keys if k not in ("conf", "sharpness")] + ["__c", "__s"]
    return named(new).join(named(existing).select(*ids).distinct(), ids, "left_anti").drop("__c", "__s")
