"""The integrity check of a tiled dataset: files without partner and overlaps between splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import tiling as T
from loomgrid.plans.views import SPLIT_NAMES


def integrity_check(images: DataFrame, masks: DataFrame, tiles: DataFrame, cell: float) -> DataFrame:
    """Problems as rows: split, split_b (null but for overlaps), problem, n.

    images, masks: split, stem. tiles: split, x0..y1; boxes that touch count as overlapping. Only the splits train, val and test
    are looked at. A split without any image is one with an empty folder: its masks are all reported.
    """
    known = F.col("split").isin(*SPLIT_NAMES)
    a, b = (x.filter(known).select("split", "stem").distinct() for x in (images, masks))
    alone = a.subtract(b).withColumn("problem", F.lit("image without mask")).unionAll(b.subtract(a).withColumn("problem", F.lit("mask without image")))
    files = alone.groupBy("split", "problem").agg(F.count(F.lit(1)).alias("n")).select("split", F.lit(None).cast("string").alias("split_b"), "problem", "n")
    overlaps = T.split_overlaps(tiles.filter(known), cell).select(F.col("split_a").alias("split"), "split_b", F.lit("overlap").alias("problem"), F.col("pairs").alias("n"))
    return files.unionAll(overlaps)
