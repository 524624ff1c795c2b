"""Masks, thresholds, tile grids, overlap blending and class decisions on pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.radiometry import tile_weight
from loomgrid.operators.spatial import checkpointed


def palm_mask(labels: DataFrame, palm_class: int, by: str = "scene") -> DataFrame:
    """Adds ``palm``: label = palm_class; where no pixel of a scene has it and the largest label is 1, label = 1."""
    facts = labels.groupBy(by).agg(F.max("cls").alias("_top"), F.max(F.col("cls") == palm_class).alias("_has"))
    cls = F.when(~F.col("_has") & (F.col("_top") == 1), 1).otherwise(palm_class)
    return labels.join(facts, by).withColumn("palm", F.col("cls") == cls).drop("_top", "_has")


def empty_masks(labels: DataFrame, palm_class: int, by: str = "scene") -> DataFrame:
    """Scenes without a pixel of the class, and the classes they do have."""
    seen = labels.groupBy(by).agg(F.array_sort(F.collect_set("cls")).alias("classes"), F.max(F.col("cls") == palm_class).alias("has"))
    return seen.filter(~F.col("has")).drop("has")


def threshold(px: DataFrame, t: float | None, p: str = "p") -> DataFrame:
    """Values not above ``t`` become 0; None leaves all."""
    return px if t is None else px.withColumn(p, F.when(F.col(p) > t, F.col(p)).otherwise(0.0))


def tile_grid(height: int, width: int, tile: int, overlap: int, spark) -> DataFrame:
    """Tile origins at every stride up to the raster's edge, in raster order: y, x."""
    if tile <= 0 or overlap < 0 or tile - overlap <= 0:
        raise ValueError("tile must be positive and larger than overlap, which must not be negative")
    s = tile - overlap
    one = spark.range(1)
    return one.select(F.explode(F.sequence(F.lit(0), F.lit(height - 1), F.lit(s))).alias("y")).select("y", F.explode(F.sequence(F.lit(0), F.lit(width - 1), F.lit(s))).alias("x"))


def to_tiles(px: DataFrame, tile: int, overlap: int) -> DataFrame:
    """A row for each tile a pixel is in (y, x: the tile's origin), found from the pixel: no join."""
    s = tile - overlap
    origins = lambda c: F.transform(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - tile + 1) / s).cast("int")), F.floor(F.col(c) / s).cast("int")), lambda k: k * s)
    return px.withColumn("y", F.explode(origins("row"))).withColumn("x", F.explode(origins("col")))


def live_tiles(px: DataFrame, keys: tuple = ("y", "x")) -> DataFrame:
    """Tiles with a valid pixel; the others aren't scored."""
    return px.groupBy(*keys).agg(F.max("valid").alias("live")).filter("live").drop("live")


def blend(scored: DataFrame, tile: int, overlap: int, taper: float = 0.1) -> DataFrame:
    """Weighted mean of overlapping tile scores: row, col, cls, p.

    scored: y, x (tile origin), row, col, cls, p, valid. Invalid pixels carry no weight; pixels without any are 0. The sums
    are taken map-side before the one shuffle.
    """
    w = F.when(F.col("valid"), tile_weight(F.col("row") - F.col("y"), F.col("col") - F.col("x"), tile, overlap, taper)).otherwise(0.0)
    sums = scored.groupBy("row", "col", "cls").agg(F.sum(F.col("p") * w).alias("pw"), F.sum(w).alias("w"))
    return sums.select("row", "col", "cls", F.when(F.col("w") > 0, F.col("pw") / F.col("w")).otherwise(0.0).alias("p"))


def decide(blended: DataFrame) -> DataFrame:
    """Class of the highest blended probability; ties and uncovered pixels take the lowest class."""
    return blended.groupBy("row", "col").agg(F.max_by("cls", F.struct("p", -F.col("cls"))).alias("cls"), F.max("p").alias("p"))


def memory_gb(height, width, n_classes):
    """Gigabytes of a dense accumulator for numbers or columns: a float per class, one for the weights, and a byte for the class."""
    return height * width * (4 * (n_classes + 1) + 1) / 1e9


def check_memory(height: int, width: int, n_classes: int, budget_gb: float) -> float:
    """Gigabytes of a dense accumulator; above the budget an error. Informative here: Spark spills."""
    need = memory_gb(height, width, n_classes)
    if need > budget_gb:
        raise MemoryError(f"{need:.1f} GB needed, budget {budget_gb} GB")
    return need


def ranked(rows: DataFrame, *order) -> DataFrame:
    """Adds ``rank`` (from 1) in the given order over all rows; sorting by it restores that order later.

    Ranks come from range partitions and their sizes: no task sorts the whole table, and only one row a partition is broadcast.
    """
    s = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = s.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return s.withColumn("_k", within).join(F.broadcast(before.select("_part", "_base")), "_part").withColumn("rank", F.col("_k") + F.col("_base")).drop("_part", "_k", "_base")


def percentile_stretch(px: DataFrame, low: float = 2, high: float = 98, value: str = "value") -> DataFrame:
    """Per band the stretch bounds over values above 0: band, lo, hi; no values: (0, 255); at least 1 apart."""
    bands = px.select("band").distinct()
    q = px.filter(F.col(value) > 0).groupBy("band").agg(F.percentile(value, F.array(F.lit(low / 100), F.lit(high / 100))).alias("q"))
    got = bands.join(q, "band", "left").select("band", F.coalesce(F.col("q")[0], F.lit(0.0)).alias("lo"), F.coalesce(F.col("q")[1], F.lit(255.0)).alias("hi"))
    return got.withColumn("hi", F.when(F.col("hi") - F.col("lo") < 1, F.col("lo") + 1).otherwise(F.col("hi")))


def confusion(pairs: DataFrame) -> DataFrame:
    """Counts of (gt, pred)."""
    return pairs.groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_scores(pairs: DataFrame) -> DataFrame:
    """IoU and F-score (percent) per class from one pass over (gt, pred)."""
    c = confusion(pairs)
    long = c.select(F.col("gt").alias("cls"), "n", F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")).unionAll(c.select(F.col("pred").alias("cls"), "n", F.lit(0).cast("long").alias("tp")))
    s = long.groupBy("cls").agg(F.sum("n").alias("both"), F.sum("tp").alias("tp"))
    return s.select("cls", (100 * F.col("tp") / (F.col("both") - F.col("tp"))).alias("iou"), (200 * F.col("tp") / F.col("both")).alias("fscore"))


def mean_scores(pairs: DataFrame) -> DataFrame:
    return class_scores(pairs).agg(F.avg("iou").alias("miou"), F.avg("fscore").alias("mfscore"))
