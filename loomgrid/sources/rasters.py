"""Scans of pixel tables: windows, tiles, overviews, bands, listings, and synthetic scenes.

A pixel table has one row per (scene, row, col[, band]) and a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.radiometry import clean

#: File extensions that count as rasters.
EXTENSIONS = (".tif", ".tiff", ".TIF", ".TIFF")


def grid(spark: SparkSession, row0: int, col0: int, rows: int, cols: int) -> DataFrame:
    """All (row, col) of a window, made where they are used."""
    n = spark.range(rows * cols)
    return n.select((row0 + F.floor(F.col("id") / cols)).cast("int").alias("row"), (col0 + F.col("id") % cols).cast("int").alias("col"))


def valid_pixels(px: DataFrame, nodata: float | None, value: str = "value", keys: tuple = ("row", "col")) -> DataFrame:
    """valid per pixel: some band differs from nodata (is not NaN where nodata is NaN); no nodata: all are."""
    v = F.col(value)
    ok = F.lit(True) if nodata is None else ~F.isnan(v) if nodata != nodata else v != nodata
    return px.groupBy(*keys).agg(F.max(ok).alias("valid"))


def read_window(px: DataFrame, row0: int, col0: int, size: int, nodata: float | None, value: str = "value") -> DataFrame:
    """Boundless window: pixels outside the raster are 0 and, with a nodata value that isn't 0, still valid as such.

    Returns row, col, band, value, valid; NaN and infinities become 0 after the mask is taken.
    """
    spark = px.sparkSession
    inside = px.filter(F.col("row").between(row0, row0 + size - 1) & F.col("col").between(col0, col0 + size - 1))
    bands = px.select("band").distinct()
    frame = grid(spark, row0, col0, size, size).crossJoin(F.broadcast(bands))  # a raster has few bands
    full = frame.join(inside.select("row", "col", "band", F.col(value).alias("value")), ["row", "col", "band"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("double"))
    mask = valid_pixels(full, nodata)
    return full.join(mask, ["row", "col"]).withColumn("value", clean(F.col("value")))


def read_tile(px: DataFrame, row0: int, col0: int, size: int, bands: list[int] | None, nodata: float | None, value: str = "value") -> DataFrame:
    """Clipped window padded with zeros to a full tile: row, col (in the tile), band, value, has_data of the tile.

    ``bands`` are counted from 1. has_data: some value inside the raster differs from nodata, or from 0 without one.
    """
    inside = px.filter(F.col("row").between(row0, row0 + size - 1) & F.col("col").between(col0, col0 + size - 1))
    chosen = px.select("band").distinct()
    if bands:
        inside, chosen = select_bands(inside, bands), select_bands(chosen, bands)
    differs = F.col(value) != (0 if nodata is None else nodata)
    has = inside.agg(F.coalesce(F.max(differs), F.lit(False)).alias("has_data"))
    frame = grid(px.sparkSession, 0, 0, size, size).crossJoin(F.broadcast(chosen)).crossJoin(F.broadcast(has))
    here = inside.select((F.col("row") - row0).alias("row"), (F.col("col") - col0).alias("col"), "band", F.col(value).cast("double").alias("value"))
    return frame.join(here, ["row", "col", "band"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def select_bands(px: DataFrame, bands: list[int]) -> DataFrame:
    """Bands by number from 1 (the column ``band`` counts from 0)."""
    return px.filter(F.col("band").isin([b - 1 for b in bands]))


def reverse_channels(px: DataFrame, modality: str, n_bands: int) -> DataFrame:
    """RGB to BGR; only for three bands of modality rgb."""
    return px.withColumn("band", F.lit(2) - F.col("band")) if modality == "rgb" and n_bands == 3 else px


def pixel_vectors(px: DataFrame, value: str = "value", cast: str = "float") -> DataFrame:
    """One row per pixel with its bands as an array in native order, and the raster's shape."""
    vectors = px.groupBy("row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", F.col(value).alias("v")))), lambda s: s["v"].cast(cast)).alias("bands"))
    shape = px.agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    return vectors.crossJoin(F.broadcast(shape))


def overview(px: DataFrame, width: int, height: int, target: int = 2048, phase: int = 0) -> DataFrame:
    """Every factor-th row and column, factor = max(1, min(width, height) // target)."""
    factor = max(1, min(width, height) // target)
    return px if factor == 1 else px.filter((F.col("row") % factor == phase) & (F.col("col") % factor == phase))


def list_rasters(names: DataFrame, pattern: str | None = None) -> DataFrame:
    """Sorted distinct ``name``s with a raster extension, or matching a glob pattern (* and ?)."""
    name = F.col("name")
    if pattern:
        regex = "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c != "_" else c) for c in pattern) + "$"
        found = names.filter(name.rlike(regex))
    else:
        found = names.filter(name.rlike("(" + "|".join(x.replace(".", "\\.") for x in EXTENSIONS) + ")$"))
    return found.select("name").distinct().orderBy("name")


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Names, sizes and splits of the files below a folder, by Spark's own reader."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    part = F.split("path", "/")
    return files.select("path", F.element_at(part, -1).alias("name"), F.element_at(part, -2).alias("split"), "length")


def stem(name: Column) -> Column:
    """File name without folders and last extension."""
    return F.regexp_extract(name, r"([^/]*?)(\.[^./]*)?$", 1)


def demo_scene(spark: SparkSession, size: int, blobs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Cones (row, col, radius of ``blobs``) joined by maximum: row, col, p, label. Only pixels under a cone are made."""
    r, c = F.ceil("radius").cast("int"), F.col
    span = lambda x: F.explode(F.sequence(F.greatest(F.lit(0), F.floor(x).cast("int") - r), F.least(F.lit(size - 1), F.ceil(x).cast("int") + r)))
    near = blobs.withColumnsRenamed({"row": "y", "col": "x"}).withColumn("row", span(c("y"))).withColumn("col", span(c("x")))
    d = F.sqrt((c("row") - c("y")) ** 2 + (c("col") - c("x")) ** 2)
    cones = near.select("row", "col", F.greatest(F.lit(0.0), 1 - d / c("radius")).alias("p")).groupBy("row", "col").agg(F.max("p").alias("p"))
    full = grid(spark, 0, 0, size, size).join(cones, ["row", "col"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return full.withColumn("label", (c("p") > threshold).cast("int"))
