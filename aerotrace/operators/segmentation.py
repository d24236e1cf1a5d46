"""Label tables of segmentation masks: remapping, coverage, confusion, IoU and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IGNORE = 255

# The common ontology, in class-id order.
CLASS_NAMES = ["Ignore", "Road", "Pavement", "Soil", "Grass", "Tree", "Vegetation", "Building", "Vehicle", "Person",
               "Pole", "Wall", "Water", "Rubble"]
TRAVERSABLE = [1, 2, 3, 4, 6]
CRITICAL = [1, 2, 3, 4, 6]
UNUSED = [0]

# Source label -> common class, per dataset; RGB codes are packed as r*65536 + g*256 + b.
RGB_CODES = {(0, 0, 0): IGNORE, (128, 0, 0): 7, (128, 64, 128): 1, (0, 128, 0): 5, (128, 128, 0): 6, (64, 0, 128): 8,
             (192, 0, 192): 8, (64, 64, 0): 9}
LABEL_MAPS = {
    "uavid": {r * 65536 + g * 256 + b: c for (r, g, b), c in RGB_CODES.items()},
    "loveda": {0: IGNORE, 1: IGNORE, 2: 7, 3: 1, 4: 12, 5: 3, 6: 5, 7: 6},
    "openearthmap": {0: IGNORE, 1: 3, 2: 4, 3: 2, 4: 1, 5: 5, 6: 12, 7: 6, 8: 7},
    "field": {0: IGNORE, **{i: i for i in range(1, len(CLASS_NAMES))}},
}

# Driving cost of the eight UAVid classes, in class-id order; infinity blocks.
INF = float("inf")
UAVID_COST = [("Clutter", 2.0), ("Building", INF), ("Road", 1.0), ("Static_Car", INF), ("Tree", INF), ("Vegetation", 1.6),
              ("Human", INF), ("Moving_Car", INF)]

BUILDING_CLASS, BUILDING_ROI, BUILDING_SHARE, BELOW_STALE_S = 1, 0.5, 0.05, 1.0


def label_maps(spark: SparkSession, maps: dict[str, dict[int, int]] = LABEL_MAPS) -> DataFrame:
    rows = [(d, k, v) for d, m in maps.items() for k, v in m.items()]
    return spark.createDataFrame(rows, "dataset string, source bigint, label int")


def packed_rgb(r, g, b) -> Column:
    return F.col(r).cast("bigint") * 65536 + F.col(g) * 256 + F.col(b)


def remap_labels(df: DataFrame, maps: dict[str, dict[int, int]] = LABEL_MAPS) -> DataFrame:
    """Common class of each (dataset, source) pixel; unmapped sources are ignored pixels."""
    m = F.broadcast(label_maps(df.sparkSession, maps))
    return df.join(m, ["dataset", "source"], "left").withColumn("label", F.coalesce("label", F.lit(IGNORE)))


def class_cost(df: DataFrame, col: str = "label", costs: Sequence[tuple[str, float]] = UAVID_COST) -> DataFrame:
    """Name and driving cost per class; classes outside the table are blocked."""
    table = df.sparkSession.createDataFrame([(i, n, c) for i, (n, c) in enumerate(costs)], f"{col} int, class_name string, cost double")
    return df.join(F.broadcast(table), col, "left").withColumn("cost", F.coalesce("cost", F.lit(INF)))


def traversable(col: str = "label") -> Column:
    return F.col(col).isin(*TRAVERSABLE)


def class_coverage(pixels: DataFrame, by: Sequence[str] = ("image_id",), col: str = "pred") -> DataFrame:
    """Share of each class in each image, with the traversable share of the image."""
    by = list(by)
    n = pixels.groupBy(*by, col).agg(F.count("*").alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.when(traversable(col), F.col("n")).otherwise(0)).alias("free"))
    return n.join(total, by).select(*by, col, "n", (F.col("n") / F.col("total")).alias("share"), (F.col("free") / F.col("total")).alias("traversable"))


def confusion(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pixel counts per (label, pred); ignored labels do not count."""
    return pixels.filter(F.col("label") != IGNORE).groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))


def iou_per_class(cm: DataFrame) -> DataFrame:
    """Intersection over union of each class that occurs, from a confusion table."""
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    sides = cm.select(F.explode(F.array(
        F.struct(F.col("label").cast("int").alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("pred").cast("int").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")))).alias("s"))
    g = sides.groupBy("s.class").agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "support", "predicted")])
    union = F.col("support") + F.col("predicted") - F.col("tp")
    return g.select("class", "tp", "support", union.alias("union"), F.when(union > 0, F.col("tp") / union).alias("iou"))


def seg_summary(cm: DataFrame) -> DataFrame:
    """Mean IoU, surface IoU, traversable IoU and the selection score, in one row."""
    iou = iou_per_class(cm).filter((F.col("support") > 0) & ~F.col("class").isin(*UNUSED) & F.col("iou").isNotNull())
    means = iou.groupBy(F.lit(1).alias("one")).agg(F.avg("iou").alias("mean_iou"), F.avg(F.when(F.col("class").isin(*CRITICAL), F.col("iou"))).alias("surface_iou"))
    t, p = traversable("label"), traversable("pred")
    cell = lambda a, b: F.sum(F.when(a & b, F.col("n")).otherwise(0))
    two = cm.groupBy(F.lit(1).alias("one")).agg(cell(t, p).alias("tt"), cell(t, ~p).alias("tn"), cell(~t, p).alias("nt"), cell(~t, ~p).alias("nn"))
    off = F.col("tn") + F.col("nt")
    a = F.when(F.col("tt") + off > 0, F.col("tt") / (F.col("tt") + off))
    b = F.when(F.col("nn") + off > 0, F.col("nn") / (F.col("nn") + off))
    trav = F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))
    d = two.withColumn("traversability_iou", trav).join(means, "one", "left").withColumn("mean_iou", F.coalesce("mean_iou", F.lit(0.0)))
    sel = (0.3 * F.col("mean_iou") + 0.5 * F.coalesce("surface_iou", "mean_iou") + 0.2 * F.coalesce("traversability_iou", "mean_iou"))
    return d.select("mean_iou", "surface_iou", "traversability_iou", sel.alias("selection"))


def class_weights(pixels: DataFrame, n_classes: int = len(CLASS_NAMES)) -> DataFrame:
    """Log-smoothed inverse frequency per class, mean 1 over present classes, kept in 0.2-10."""
    counts = pixels.filter(F.col("label") != IGNORE).groupBy(F.col("label").cast("int").alias("class")).agg(F.count("*").alias("pixels"))
    full = pixels.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class")).join(counts, "class", "left")
    w = Window.partitionBy(F.lit(1))  # n_classes rows
    raw = 1.0 / F.log(1.02 + F.col("pixels") / F.sum("pixels").over(w))
    d = full.withColumn("__raw", F.when(F.col("pixels") > 0, raw))
    weight = F.greatest(F.lit(0.2), F.least(F.lit(10.0), F.col("__raw") / F.avg("__raw").over(w)))
    return d.select("class", F.coalesce("pixels", F.lit(0)).alias("pixels"),
                    F.when(F.col("class").isin(*UNUSED), 0.0).when(F.col("__raw").isNull(), 1.0).otherwise(weight).alias("weight"))


def best_epoch(log: DataFrame, by: Sequence[str] = (), score: Column | None = None) -> DataFrame:
    """Epoch with the highest selection score, the earliest among equals."""
    s = score if score is not None else (0.3 * F.col("mean_iou") + 0.5 * F.col("surface_iou") + 0.2 * F.col("traversability_iou"))
    best = F.max_by(F.struct("epoch", "__s"), F.struct("__s", -F.col("epoch"))).alias("b")
    return log.withColumn("__s", s).groupBy(*by).agg(best).select(*by, "b.epoch", F.col("b.__s").alias("selection"))


def decision_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates of binary decisions; a rate without a denominator is NULL."""
    t, p = F.col("truth") == 1, F.col("pred") == 1
    g = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return g.withColumns({"accuracy": F.try_divide(F.col("tp") + F.col("tn"), n), "precision": F.try_divide("tp", F.col("tp") + F.col("fp")),
                          "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})


def obstacle_counts(hits: DataFrame, by: Sequence[str] = ("image_id",), label: str = "label") -> DataFrame:
    """Obstacle instances per class and their share of all instances of the image."""
    by = list(by)
    n = hits.groupBy(*by, label).agg(F.count("*").alias("n"))
    return n.join(n.groupBy(*by).agg(F.sum("n").alias("total")), by).select(*by, label, "n", (F.col("n") / F.col("total")).alias("share"))


def obstacle_area(mapped: DataFrame, obstacles: DataFrame, by: Sequence[str] = ("image_id",), at: Sequence[str] = ("r", "c")) -> DataFrame:
    """Share of the mapped cells of an image that obstacles cover; a cell that several cover counts once."""
    cells = [*by, *at]
    covered = obstacles.select(*cells).distinct().withColumn("__hit", F.lit(1))
    d = mapped.select(*cells).distinct().join(covered, cells, "left")
    return d.groupBy(*by).agg(F.count("*").alias("mapped"), F.count("__hit").alias("covered"), F.avg(F.coalesce("__hit", F.lit(0)).cast("double")).alias("area_share"))


def building_below(pixels: DataFrame, h: int, w: int, by: Sequence[str] = ("image_id",), col: str = "pred", roi: float = BUILDING_ROI,
                   share: float = BUILDING_SHARE) -> DataFrame:
    """Flag frames whose central region holds more than ``share`` building pixels."""
    rh, rw = int(h * roi / 2), int(w * roi / 2)
    inside = F.col("r").between(h // 2 - rh, h // 2 + rh - 1) & F.col("c").between(w // 2 - rw, w // 2 + rw - 1)
    frac = F.avg(F.when(F.col(col) == BUILDING_CLASS, 1.0).otherwise(0.0))
    return pixels.filter(inside).groupBy(*by).agg(frac.alias("building_share")).withColumn("building_below", (F.col("building_share") > share).cast("int"))


def ground_clear(flags: DataFrame, now: Column, ts: str = "ts", limit: float = BELOW_STALE_S) -> DataFrame:
    """True only for a recent flag that says there is no building; no recent flag is unsafe."""
    return flags.withColumn("ground_clear", F.coalesce((now - F.col(ts) < limit) & (F.col("building_below") == 0), F.lit(False)))


def hold_stride(frames: DataFrame, labels: DataFrame, n: int, by: Sequence[str] = ("mission_id",), order: str = "frame") -> DataFrame:
    """Label of every frame when only each n-th is scored: skipped frames keep the last one."""
    from aerotrace.operators import ordered

    by = list(by)
    scored = labels.filter(F.col(order) % n == 0)
    d = frames.join(scored, [*by, order], "left")
    return ordered.carry(d, by, [order], F.floor(F.col(order) / 4096), F.col("label"), prev="held_label")
