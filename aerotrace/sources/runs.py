"""Run folders: logs, identity records, buffers, metric files and file pairing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerotrace.functions import text
from aerotrace.operators import logs, ordered


def read_mission_log(spark: SparkSession, path) -> DataFrame:
    """Parsed log lines numbered from 1 within each file, blank lines skipped.

    A file split is read by one task from start to end, so (split start, row id) is the file
    order; counting per split numbers the lines without loading a file whole.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__row"), F.rtrim(F.col("value")).alias("line"))
    raw = raw.withColumn("mission_id", text.path_part("path", 2))
    d = ordered.running_sum(raw, ["path"], ["__block", "__row"], F.floor(F.col("__block") / (1 << 20)), F.lit(1), "line_no")
    return logs.parse_lines(d.drop("__block", "__row")).select("mission_id", "line_no", "level", "msg", "path")


def format_log(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("["), F.rpad(F.col("level"), 7, " "), F.lit("] "), F.col("msg")).alias("value"))


def write_mission_log(df: DataFrame, path: str, order: Sequence[str] = ("line_no",)) -> None:
    """Append formatted lines, sorted within each mission's output."""
    lines = df.select("mission_id", *order, F.concat(F.lit("["), F.rpad(F.col("level"), 7, " "), F.lit("] "), F.col("msg")).alias("value"))
    (lines.repartitionByRange("mission_id", *order).sortWithinPartitions("mission_id", *order)
     .select("value", "mission_id").write.partitionBy("mission_id").mode("append").text(path))


# ---- identity records ---------------------------------------------------------------------

# Field names of a record, after lower-casing and joining words.
HEADER_FIELDS = {"gid": "bigint", "created": "string", "mission_folder": "string"}
FINAL_FIELDS = {"samples": "bigint", "latitude": "double", "longitude": "double"}
BUFFER_FIELDS = {"wall_time": "string", "ros_assignment_time": "double", "mission_timestamp": "string", "buffer_gallery_size": "bigint",
                 "cumulative_gallery": "bigint", "buffer_crops_saved": "bigint", "first_frame": "bigint", "last_frame": "bigint",
                 "best_confidence": "double", "best_sharpness": "double", "representative_frame": "bigint",
                 "gid_medoid_latitude": "double", "gid_medoid_longitude": "double"}


def parse_identity_text(docs: DataFrame, key: Sequence[str] = ("path",), col: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers, buffers and buffer entries of identity records, one record text per row."""
    key = list(key)
    d = docs.select(*key, F.posexplode(F.split(F.col(col), r"\r?\n")).alias("pos", "raw")).withColumn("line", F.rtrim("raw"))
    line = F.col("line")
    rule = line.rlike(r"^[=\- ]*$")
    is_buf = line.startswith("BUFFER ")
    is_final = line.startswith("FINAL GPS") | line.contains("FINAL GPS (")
    is_table = line.startswith("Frame") & line.contains("Conf") & line.contains("Sharpness")
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("buffer_no", F.sum(is_buf.cast("int")).over(w))
    d = d.withColumn("in_table", F.coalesce(F.last(F.when(is_table, True).when(is_buf | rule, False), ignorenulls=True).over(w), F.lit(False)))
    body = d.filter(~rule & ~is_buf & ~is_final & ~is_table)
    part = F.split(F.trim("line"), r"\s+")
    entries = body.filter("in_table AND buffer_no > 0").withColumn("p", part).filter(F.size("p") >= 5)
    entries = entries.select(*key, "buffer_no", "pos", *[text.number(F.col("p")[i]).cast(t).alias(n) for i, (n, t) in enumerate(
        (("frame", "bigint"), ("conf", "double"), ("sharpness", "double"), ("lat", "double"), ("lon", "double")))])
    kv = body.filter(~F.col("in_table") & line.contains(":"))
    kv = kv.withColumns({"k": F.trim(F.regexp_extract("line", r"^([^:]*):", 1)), "v": F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))})
    final = F.col("k").startswith("Final GPS")
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace("k", "^Final GPS", ""))), " ", "_"), r"\.", "")
    kv = kv.withColumns({"final": final, "name": name})

    head = F.col("buffer_no") == 0
    pick = lambda n, t, cond: (lambda v: (v if t == "string" else text.number(v).cast(t)).alias(n))(
        F.max_by(F.col("v"), F.when(cond & (F.col("name") == n), F.col("pos"))))
    headers = kv.groupBy(*key).agg(*[pick(n, t, head & ~F.col("final")) for n, t in HEADER_FIELDS.items()],
                                   *[pick(n, t, F.col("final")) for n, t in FINAL_FIELDS.items()])
    marks = d.filter(is_buf).select(*key, "buffer_no", F.lower(F.regexp_extract("line", r"^BUFFER\s+(\w+)", 1)).alias("event"),
                                    text.null_if_blank(F.regexp_extract("line", r"TID=(-?\d+)", 1)).try_cast("bigint").alias("tid"))
    fields = kv.filter(~F.col("final") & (F.col("buffer_no") > 0)).groupBy(*key, "buffer_no").agg(*[pick(n, t, F.lit(True)) for n, t in BUFFER_FIELDS.items()])
    return headers, marks.join(fields, [*key, "buffer_no"], "left"), entries


def read_identity_records(spark: SparkSession, path) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers, buffers and entries from ``metadata.txt`` files (a few kilobytes each)."""
    docs = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_identity_text(docs)


def list_runs(spark: SparkSession, root: str, since: float | None = None) -> DataFrame:
    """Run folders with a mission log, newest first, with their number of identity folders."""
    def listing(name):
        return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
                .select("path", "modificationTime", "length"))

    runs = listing("mission.log").withColumns({"run": text.path_part("path", 2), "mtime": F.unix_micros("modificationTime") / 1e6})
    gids = listing("metadata.txt").filter(text.path_part("path", 2).rlike(r"^gid_\d+$")).groupBy(text.path_part("path", 3).alias("run")).agg(F.count("*").alias("gids"))
    d = runs.select("run", "path", "mtime", "length", text.run_started_at("run").alias("started_at")).join(gids, "run", "left").withColumn("gids", F.coalesce("gids", F.lit(0)))
    if since is not None:
        d = d.filter(F.col("mtime") >= since)
    return d.orderBy(F.col("mtime").desc(), F.col("run").desc())


def pair_recordings(files: DataFrame) -> DataFrame:
    """Log of each video: the CSV of the same stem, else the only CSV of the folder, else NULL.

    ``files`` has ``dir`` and ``name``.
    """
    f = files.withColumns({"stem": text.stem("name"), "ext": F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))})
    csv = f.filter("ext = 'csv'").select("dir", "stem", F.col("name").alias("csv"))
    only = csv.groupBy("dir").agg(F.count("*").alias("n"), F.min("csv").alias("lone")).filter("n = 1").select("dir", "lone")
    video = f.filter(F.col("ext").isin("mp4", "avi", "mov", "mkv"))
    d = video.join(csv.groupBy("dir", "stem").agg(F.min("csv").alias("csv")), ["dir", "stem"], "left").join(only, "dir", "left")
    return d.select("dir", F.col("name").alias("video"), F.coalesce("csv", "lone").alias("log"))


# Folder names of each training set.
LAYOUTS = {
    "uavid": dict(img=["Images", "images"], lbl=["Labels", "labels", "TrainId", "Annotations"], train=["uavid_train"], val=["uavid_val"]),
    "loveda": dict(img=["images_png", "images"], lbl=["masks_png", "masks", "labels"], train=["train"], val=["val"]),
    "openearthmap": dict(img=["images"], lbl=["label", "labels"], train=["train"], val=["val"]),
    "field": dict(img=["images", "Images"], lbl=["labels", "Labels", "masks"], train=["train"], val=["val"]),
}


def pair_images_labels(files: DataFrame, layout: Mapping[str, Sequence[str]]) -> DataFrame:
    """Image and label of one stem, where the label folder replaces the image folder in the path.

    ``files`` has ``path`` relative to the data set. The deepest image folder is substituted, and
    the first label folder name that exists wins.
    """
    f = files.withColumns({"parts": F.split("path", "/"), "stem": text.stem("path")})
    f = f.withColumn("dir", F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/"))
    names = F.array(*[F.lit(n) for n in layout["img"]])
    folders = F.slice("parts", 1, F.size("parts") - 1)
    at = F.array_max(F.transform(folders, lambda p, i: F.when(F.array_contains(names, p), i + 1)))
    img = f.withColumn("at", at).filter(F.col("at").isNotNull())
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("lbl")) for i, n in enumerate(layout["lbl"])]))
    img = img.withColumn("c", choice)
    moved = F.array_join(F.transform(folders, lambda p, i: F.when(i + 1 == F.col("at"), F.col("c.lbl")).otherwise(p)), "/")
    img = img.withColumn("ldir", moved)
    dirs = f.select(F.col("dir").alias("ldir")).distinct()
    first = img.select("dir", "ldir", "c.rank").distinct().join(dirs, "ldir", "left_semi").groupBy("dir").agg(F.min_by("ldir", "rank").alias("ldir"))
    labels = f.groupBy(F.col("dir").alias("ldir"), "stem").agg(F.max("path").alias("label"))
    d = img.select("path", "stem", "dir").distinct().join(first, "dir").filter("dir <> ldir").join(labels, ["ldir", "stem"])
    return d.select(F.col("path").alias("image"), "label", "stem")


def split_dataset(pairs: DataFrame, lists: DataFrame | None, layout: Mapping[str, Sequence[str]], seed: int = 0, share: float = 0.1) -> DataFrame:
    """Add ``split``: by split lists, else folder markers, else a seeded hold-out.

    ``lists`` has ``stem`` and ``split``. The hold-out keeps the lowest seeded hashes; the size
    follows ``share`` exactly.
    """
    from aerotrace.operators.clouds import hash_sample

    if lists is not None:
        one = lists.select("stem", "split").distinct()
        d = pairs.join(one, "stem").select("image", "label", "stem", "split")
        if d.select("split").distinct().count() == 2:
            return d
    low = F.transform(F.split("image", "/"), F.lower)
    has = lambda marks: F.arrays_overlap(low, F.array(*[F.lit(m.lower()) for m in marks]))
    d = pairs.withColumn("split", F.when(has(layout["train"]), "train").when(has(layout["val"]), "val")).filter(F.col("split").isNotNull())
    if d.select("split").distinct().count() == 2:
        return d
    n = max(1, int(pairs.count() * share))
    val = hash_sample(pairs.withColumn("__one", F.lit(1)), n, ["__one"], ["image"], seed).select("image").withColumn("split", F.lit("val"))
    return pairs.join(val, "image", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def scene_manifest(files: DataFrame) -> DataFrame:
    """Scenes with both model and thumbnail, one row per depth picture in name order.

    ``files`` has ``path`` as group/scene/...; scenes without pictures keep one row.
    """
    p = F.split("path", "/")
    f = files.withColumns({"group": p[0], "scene": p[1], "rest": F.array_join(F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0))), "/")})
    ok = f.groupBy("group", "scene").agg(F.bool_or(F.col("rest") == "scene.glb").alias("m"), F.bool_or(F.col("rest") == "scene.jpg").alias("t")).filter("m AND t").select("group", "scene")
    pic = f.filter(F.col("rest").rlike(r"(?i)^depth_vis/[^/]*\.(jpg|jpeg|png|webp)$")).select("group", "scene", F.col("path").alias("picture"))
    d = ok.join(pic, ["group", "scene"], "left")
    return d.withColumn("picture_no", F.when(F.col("picture").isNotNull(), F.row_number().over(Window.partitionBy("group", "scene").orderBy("picture"))))


# ---- poses and LiDAR ----------------------------------------------------------------------

FRAME_NAMES = ("frame", "frame_id", "frameid", "index", "idx", "id", "n")


def parse_poses(rows: DataFrame, convention: str = "w2c", order: str = "zyx", radians: bool = False) -> DataFrame:
    """World-to-camera matrices from matrix, quaternion or Euler columns, chosen by the header."""
    from aerotrace.functions import rotations as rot

    low = {c.lower().strip(): c for c in rows.columns if not c.startswith("__")}
    num = lambda n: F.trim(F.col(f"`{low[n]}`")).try_cast("double")
    # a value named by a lambda is computed once a row; written out at every use, the casts of one quaternion make some ten thousand
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    numbers = lambda names, f: once(F.struct(*[num(n).alias(f"c{i}") for i, n in enumerate(names)]), lambda v: f(*[v[f"c{i}"] for i in range(len(names))]))
    frame = next((n for n in low if n in FRAME_NAMES), next(iter(low)))
    xyz = next((t for t in (("tx", "ty", "tz"), ("x", "y", "z")) if set(t) <= set(low)), None)
    nine = [f"r{i}{j}" for i in range(3) for j in range(3)]
    if set(nine) <= set(low) and xyz:
        m = rot.mat4([[num(f"r{i}{j}") for j in range(3)] for i in range(3)], [num(k) for k in xyz])
    elif xyz and {"qx", "qy", "qz", "qw"} <= set(low):
        m = numbers(["qx", "qy", "qz", "qw", *xyz], rot.quat_to_mat)
    elif {"x", "y", "z", "roll", "pitch", "yaw"} <= set(low):
        m = numbers(["roll", "pitch", "yaw", *"xyz"], lambda *v: rot.euler_to_mat(*v, order=order, radians=radians))
    else:
        rest = [n for n in low if n != frame]
        if len(rest) < 12:
            raise ValueError(f"no pose columns in {list(low)}")
        c = [num(n) for n in rest[:12]]
        m = rot.mat4([[c[4 * i + j] for j in range(3)] for i in range(3)], [c[4 * i + 3] for i in range(3)])
    d = rows.select(F.floor(num(frame)).cast("bigint").alias("frame"), m.alias("m"), *[c for c in rows.columns if c.startswith("__")])
    d = d.filter(F.col("frame").isNotNull() & F.forall("m", lambda v: v.isNotNull() & ~F.isnan(v)))
    return d.withColumn("m", once(F.col("m"), rot.se3_inverse)) if convention == "c2w" else d


def read_poses(spark: SparkSession, path, convention: str = "w2c", **kw) -> DataFrame:
    from aerotrace.sources.flight_logs import _csv

    return parse_poses(_csv(spark, path), convention, **kw)


def read_lidar(spark: SparkSession, path) -> DataFrame:
    """Sweeps of a beam log; rows keep the order of the file."""
    from aerotrace.operators import lidar

    raw = spark.read.option("header", True).csv(path)
    cols = [*lidar.POSE, "target_angle_deg", "cam_angle_deg", "cam_range_m"]
    lost = [c for c in cols if c not in raw.columns]
    if lost:
        raise ValueError(f"LiDAR log lacks {lost}")
    d = raw.select(F.col("_metadata.file_path").alias("flight"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"),
                   *[F.trim(c).try_cast("double").alias(c) for c in cols])
    d = ordered.running_sum(d, ["flight"], ["__block", "__id"], F.floor(F.col("__block") / (1 << 20)), F.lit(1), "row")
    return lidar.sweeps(lidar.sessionize(d, ["flight"]), ["flight"])


def concat_datasets(parts: Sequence[DataFrame], source: str = "part") -> DataFrame:
    """Samples of several datasets as one; ``source`` holds the number of the part. Columns are matched by name, and NULL where a part lacks one."""
    first, *rest = [d.withColumn(source, F.lit(i)) for i, d in enumerate(parts)]
    for d in rest:
        first = first.unionByName(d, allowMissingColumns=True)
    return first


# ---- stores -------------------------------------------------------------------------------


def write_buffers(df: DataFrame, path: str) -> None:
    """Append buffer records; the current state of an identity is a view over the appended log."""
    df.write.mode("append").partitionBy("mission_id").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Depth, confidence and pose rows, one folder per scene."""
    df.write.mode("append").partitionBy("scene").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON object per dataset and mode: scene to metric to value. Other datasets and modes in the folder stay.

    A benchmark has at most some hundred scenes per dataset.
    """
    scene = metrics.groupBy("dataset", "mode", "scene").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    doc = scene.groupBy("dataset", "mode").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("scene", "m")))).alias("value"))
    doc.write.partitionBy("dataset", "mode").option("partitionOverwriteMode", "dynamic").mode("overwrite").text(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All metric files as rows; unreadable files are skipped."""
    doc = spark.read.option("wholetext", True).text(path)
    d = doc.withColumn("m", F.from_json("value", "map<string,map<string,double>>")).filter(F.col("m").isNotNull())
    d = d.select("dataset", "mode", F.explode("m").alias("scene", "mm"))
    return d.select(F.col("dataset").cast("string"), F.col("mode").cast("string"), "scene", F.explode("mm").alias("metric", "value"))
