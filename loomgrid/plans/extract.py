"""Whole plans: pixels to crowns, scores to labels, and both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.instances import assign_voronoi, assign_watershed, crowns, trees
from loomgrid.operators.pixels import blend, decide, live_tiles, palm_mask, to_tiles
from loomgrid.operators.seeds import find_seeds
from loomgrid.operators.spatial import checkpointed, deduplicate_rings

METHODS = ("watershed", "voronoi")


def extract_trees(px: DataFrame, method: str = "watershed", blur_size: int = 5, prob_threshold: float = 0.5, min_area: float = 9, min_circularity: float = 0.0, min_seed_distance: float = 0, has_heatmap: bool = True) -> tuple[DataFrame, DataFrame]:
    """Instance pixels and trees of scenes (scene, row, col, palm, p)."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    seeds = checkpointed(find_seeds(px, has_heatmap, blur_size, prob_threshold, min_seed_distance))
    if method == "watershed":
        instances = assign_watershed(px, seeds, has_heatmap=has_heatmap)
    else:
        mask = px.filter("palm").select("scene", "row", "col")
        instances = assign_voronoi(mask, seeds, by=("scene",)).select("scene", "row", "col", F.coalesce("inst", F.lit(0)).alias("inst"))
    instances = checkpointed(instances)
    full = instances.join(px.select("scene", "row", "col", "p"), ["scene", "row", "col"]) if has_heatmap else instances
    return instances, trees(full, "p" if has_heatmap else None, min_area, min_circularity)


def extract(px: DataFrame, transform: tuple, palm_class: int = 1, geometry: str = "circle", dedup_iou: float = 0.0, **tuning) -> DataFrame:
    """Crown layer of label rasters (scene, row, col, cls, p): see crowns. Of crowns of a scene that overlap by dedup_iou or more (of their rings) the best stays."""
    masked = palm_mask(px, palm_class)
    _, found = extract_trees(masked, **tuning)
    layer = crowns(found, transform, geometry)
    if dedup_iou <= 0:
        return layer
    xs, ys = F.transform("ring", lambda q: q["x"]), F.transform("ring", lambda q: q["y"])
    bounds = {"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)}
    boxes = checkpointed(layer.withColumns(bounds))
    size = boxes.agg(F.max(F.col("x1") - F.col("x0"))).first()[0] or 1.0
    return deduplicate_rings(boxes, dedup_iou, size, by=("scene",)).select(*layer.columns)


def segment(px: DataFrame, scorer: Callable[[DataFrame], DataFrame], tile: int = 512, overlap: int = 128, palm_class: int = 1) -> DataFrame:
    """Label and heatmap of a raster by a scoring function supplied by the caller: row, col, cls, p (of palm_class).

    px: row, col, valid and what the scorer reads. Tiles without a valid pixel aren't scored; pixels in no scored tile get class 0 and p 0.
    """
    tiles = to_tiles(px, tile, overlap)
    tiled = scorer(tiles.join(live_tiles(tiles), ["y", "x"], "left_semi"))
    blended = checkpointed(blend(tiled, tile, overlap))
    heat = blended.filter(F.col("cls") == palm_class).select("row", "col", F.col("p").alias("heat"))
    found = decide(blended).drop("p").join(heat, ["row", "col"], "left")
    every = px.select("row", "col").join(found, ["row", "col"], "left")
    return every.select("row", "col", F.coalesce("cls", F.lit(0)).alias("cls"), F.coalesce("heat", F.lit(0.0)).alias("p"))


def segment_and_extract(px: DataFrame, scorer, transform: tuple, tile: int = 512, overlap: int = 128, palm_class: int = 1, **tuning) -> DataFrame:
    out = segment(px, scorer, tile, overlap, palm_class).withColumn("scene", F.lit("scene"))
    return extract(out, transform, palm_class, **tuning)
