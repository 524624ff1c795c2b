"""Vector layers: annotation sources, split regions, GeoJSON lines; and the sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON lines: the properties (a DDL schema) and the outer ring as structs x, y."""
    schema = f"properties struct<{properties}>, geometry struct<type string, coordinates array<array<array<double>>>>"
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("f")).filter("f.geometry is not null")
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rows.select("f.properties.*", ring.alias("ring"))


def geojson(rows: DataFrame, ring: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row, as text in ``value``."""
    points = F.transform(F.col(ring), lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def annotations(sources: list[DataFrame], classes: DataFrame, min_area: float) -> DataFrame:
    """Join sources (class_name, area and more) to class values: null areas and small polygons go, names are stripped.

    ``classes`` is the dimension class_name, cls; unknown names are left out. Sorted by class.
    """
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    known = whole.filter(F.col("area").isNotNull() & (F.col("area") >= min_area)).withColumn("class_name", F.trim("class_name"))
    return known.join(F.broadcast(classes), "class_name").orderBy("cls")  # a class list has at most 255 rows


def split_regions(regions: DataFrame, field: str = "split") -> DataFrame:
    """Normalise the split column (lower case, stripped); see invalid_splits for the others."""
    if field not in regions.columns:
        raise KeyError(field)
    return regions.withColumn(field, F.lower(F.trim(field)))


def invalid_splits(regions: DataFrame, field: str = "split") -> DataFrame:
    """Distinct split values that are none of train, val, test."""
    return split_regions(regions, field).select(field).distinct().filter(~F.col(field).isin(*SPLITS) | F.col(field).isNull())


def require_splits(regions: DataFrame, field: str = "split") -> DataFrame:
    bad = [r[0] for r in invalid_splits(regions, field).limit(10).collect()]
    if bad:
        raise ValueError(f"invalid split values: {bad}")
    return split_regions(regions, field)


def write_pixels(px: DataFrame, path: str, by: str = "scene") -> None:
    """Rasters (labels, heatmaps, instances, tiles): Parquet, one folder per scene, rows in raster order."""
    px.repartition(by).sortWithinPartitions(by, "row", "col").write.mode("overwrite").partitionBy(by).parquet(path)


def write_layer(rows: DataFrame, path: str, ring: str, properties: list[str]) -> None:
    """GeoJSON lines for .geojson and .json, else Parquet."""
    if path.endswith((".geojson", ".json")):
        geojson(rows, ring, properties).write.mode("overwrite").text(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def write_summary(batch: DataFrame, path: str) -> None:
    """CSV with header file,status,tree_count,error: done, skipped, failed; names without folders."""
    batch_rows(batch).drop("rank").write.mode("overwrite").csv(path, header=True)


def batch_rows(batch: DataFrame) -> DataFrame:
    rank = F.when(F.col("status") == "ok", 0).when(F.col("status") == "skipped", 1).otherwise(2)
    name: Column = F.regexp_extract(F.col("file").cast("string"), "([^/]*)$", 1)
    return batch.select(rank.alias("rank"), name.alias("file"), "status", "tree_count", "error").orderBy("rank", "file")


def palette_json(classes: DataFrame) -> DataFrame:
    """One JSON object of class names by value, background included."""
    pairs = classes.select(F.struct(F.col("cls").cast("string").alias("k"), F.col("class_name").alias("v")).alias("e"))
    background = F.array(F.struct(F.lit("0").alias("k"), F.lit("background").alias("v")))
    return pairs.agg(F.to_json(F.map_from_entries(F.concat(background, F.array_sort(F.collect_list("e"))))).alias("value"))
