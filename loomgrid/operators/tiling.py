"""Training tiles from mosaics: region grids, boundary rules, burning, coverage, numbering, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.geometry import apply_affine, box_ring, boxes_touch, clipped, common_area, invert_affine, overlap_area, point_in_ring
from loomgrid.operators.spatial import box_pairs


def region_grid(regions: DataFrame, transform: tuple, width: int, height: int, tile: int, overlap: int) -> DataFrame:
    """Tiles of each region (region_id, x0..y1 in map units): region_id, r, c, x_off, y_off.

    The grid hangs on the region's upper left pixel (rounded down; its lower right rounded up), within the raster. Regions outside of it have no tiles.
    """
    stride = tile - overlap
    ca, ra = invert_affine("x0", "y0", transform)
    cb, rb = invert_affine("x1", "y1", transform)
    low = lambda a, b: F.greatest(F.floor(F.least(a, b)), F.lit(0))
    high = lambda a, b, most: F.least(F.ceil(F.greatest(a, b)), F.lit(most))
    px = regions.withColumns({"pc0": low(ca, cb), "pc1": high(ca, cb, width), "pr0": low(ra, rb), "pr1": high(ra, rb, height)}).filter("pc1 > pc0 and pr1 > pr0")
    n = lambda a, b: F.when(F.col(b) - F.col(a) > overlap, F.ceil((F.col(b) - F.col(a) - overlap) / stride)).otherwise(1)
    g = px.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), n("pr0", "pr1").cast("long") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), n("pc0", "pc1").cast("long") - 1)))
    g = g.withColumns({"x_off": F.col("pc0") + F.col("c") * stride, "y_off": F.col("pr0") + F.col("r") * stride})
    return g.filter((F.col("x_off") < width) & (F.col("y_off") < height)).drop("pc0", "pc1", "pr0", "pr1")


def tile_boxes(tiles: DataFrame, transform: tuple, tile: int) -> DataFrame:
    """Adds the tiles' boxes in map units: x0, y0, x1, y1."""
    xa, ya = apply_affine("x_off", "y_off", transform)
    xb, yb = apply_affine(F.col("x_off") + tile, F.col("y_off") + tile, transform)
    return tiles.drop("x0", "y0", "x1", "y1").withColumns({"x0": F.least(xa, xb), "y0": F.least(ya, yb), "x1": F.greatest(xa, xb), "y1": F.greatest(ya, yb)})


def inside_own_region(tiles: DataFrame, regions: DataFrame, mode: str = "strict") -> DataFrame:
    """Tiles (region_id and box) that their region covers (strict) or meets (mask).

    Regions are boxes, or polygons where they have a column ``ring`` besides their box: a polygon covers a tile when the area they share
    is the tile's (to one part in a billion), and meets it when they share any.
    """
    j = tiles.alias("t").join(regions.alias("r"), F.col("t.region_id") == F.col("r.region_id"))
    c = lambda a: F.col(a)
    if "ring" in regions.columns:
        area = (c("t.x1") - c("t.x0")) * (c("t.y1") - c("t.y0"))
        met = j.filter(boxes_touch("t", "r")).withColumn("_met", common_area(box_ring("t.x0", "t.y0", "t.x1", "t.y1"), c("r.ring")))
        return met.filter(c("_met") >= area * (1 - 1e-9) if mode == "strict" else c("_met") > 0).select("t.*")
    if mode == "strict":
        ok = (c("t.x0") >= c("r.x0")) & (c("t.y0") >= c("r.y0")) & (c("t.x1") <= c("r.x1")) & (c("t.y1") <= c("r.y1"))
    else:
        ok = (c("t.x0") <= c("r.x1")) & (c("t.x1") >= c("r.x0")) & (c("t.y0") <= c("r.y1")) & (c("t.y1") >= c("r.y0"))
    return j.filter(ok).select("t.*")


def straddling(tiles: DataFrame, regions: DataFrame, cell: float) -> DataFrame:
    """Ids of tiles (tile_id, region_id, box) that share more than 1e-6 of their area with another region (a box, or a polygon with a column ``ring``)."""
    pairs = box_pairs(tiles, regions, cell).filter(F.col("a.region_id") != F.col("b.region_id"))
    area = (F.col("a.x1") - F.col("a.x0")) * (F.col("a.y1") - F.col("a.y0"))
    pairs = pairs.filter(overlap_area("a", "b") > 1e-6 * area)
    if "ring" in regions.columns:
        pairs = pairs.filter(common_area(box_ring("a.x0", "a.y0", "a.x1", "a.y1"), F.col("b.ring")) > 1e-6 * area)
    return pairs.select(F.col("a.tile_id").alias("tile_id")).distinct()


def reject_straddling(tiles: DataFrame, regions: DataFrame, cell: float) -> DataFrame:
    return tiles.join(straddling(tiles, regions, cell), "tile_id", "left_anti")


def split_overlaps(tiles: DataFrame, cell: float) -> DataFrame:
    """Pairs of touching tiles of different splits, counted for train-val, train-test, val-test."""
    pairs = box_pairs(tiles, tiles, cell).filter(F.col("a.split") != F.col("b.split"))
    rank = lambda c: F.when(F.col(c) == "train", 0).when(F.col(c) == "val", 1).otherwise(2)
    return pairs.filter(rank("a.split") < rank("b.split")).groupBy(F.col("a.split").alias("split_a"), F.col("b.split").alias("split_b")).agg(F.count(F.lit(1)).alias("pairs"))


def candidates(tiles: DataFrame, annotations: DataFrame, cell: float) -> DataFrame:
    """Annotations (annot_id, cls, box) that meet each tile (tile_id, box); those with a column ``ring`` must share some area with it."""
    pairs = box_pairs(tiles, annotations, cell)
    if "ring" in annotations.columns:
        pairs = pairs.filter(common_area(box_ring("a.x0", "a.y0", "a.x1", "a.y1"), F.col("b.ring")) > 0)
    return pairs.select(F.col("a.tile_id").alias("tile_id"), F.col("b.annot_id").alias("annot_id"), F.col("b.cls").alias("cls"))


def pixels_inside(pixels: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Pairs of a pixel (x, y of its centre, and keys) and a polygon (ring, box) whose ring holds the centre, with the columns of both but x, y, ring and box."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    spread = polygons.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1")).drop("x0", "y0", "x1", "y1")
    p = pixels.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    return p.join(spread, ["cx", "cy"]).filter(point_in_ring(F.col("x"), F.col("y"), "ring")).drop("cx", "cy", "x", "y", "ring")


def burn(pixels: DataFrame, polygons: DataFrame, cell: float, region_mask: str | None = None) -> DataFrame:
    """Adds ``mask``: the largest class of the polygons whose ring holds the pixel's centre, else 0.

    pixels: x, y (map coordinates of the centre) and further columns, which together are a key without nulls. polygons: cls, ring, x0..y1. Painting in rising class order leaves
    the largest class on top. Pixels where ``region_mask`` is false are 0.
    """
    keys = [k for k in pixels.columns if k not in ("x", "y")]
    met = pixels_inside(pixels, polygons.select("cls", "ring", "x0", "y0", "x1", "y1"), cell).groupBy(*keys).agg(F.max("cls").alias("mask"))
    out = pixels.join(met, keys, "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    return out.withColumn("mask", F.when(F.col(region_mask), F.col("mask")).otherwise(0)) if region_mask else out


def blacken(px: DataFrame, inside: str, value: str = "value") -> DataFrame:
    return px.withColumn(value, F.when(F.col(inside), F.col(value)).otherwise(0))


def tiles_with_data(px: DataFrame, nodata: float | None, keys: list[str], value: str = "value") -> DataFrame:
    return px.groupBy(*keys).agg(F.max(F.col(value) != (0 if nodata is None else nodata)).alias("has")).filter("has").drop("has")


def covered_tiles(px: DataFrame, nodata: float | None, least: float, keys: list[str], value: str = "value") -> DataFrame:
    """Tiles of which at least the share ``least`` of all values, over all bands, isn't nodata: keys, coverage."""
    share = F.count_if(F.col(value) != (0 if nodata is None else nodata)) / F.count(F.lit(1))
    return px.groupBy(*keys).agg(share.alias("coverage")).filter(F.col("coverage") >= least)


def foreground_tiles(masks: DataFrame, keys: list[str], value: str = "mask") -> DataFrame:
    return masks.groupBy(*keys).agg(F.max(value).alias("top")).filter("top > 0").drop("top")


def number_tiles(tiles: DataFrame, start: int | Column = 0) -> DataFrame:
    """Adds tile_id and tile_name, counted from ``start`` per job and split in order of region, row, column."""
    w = Window.partitionBy("job_name", "split").orderBy("region_id", "r", "c")
    n = F.row_number().over(w) - 1 + start
    return tiles.withColumn("tile_id", n.cast("long")).withColumn("tile_name", F.format_string("%s_%s_tile_%06d", "job_name", "split", n))


def next_index(names: DataFrame) -> DataFrame:
    """One row: the largest tile number in ``name`` plus one, or 0."""
    n = F.regexp_extract("name", r"_tile_(\d+)", 1)
    return names.filter(n != "").agg(F.coalesce(F.max(n.cast("long")) + 1, F.lit(0).cast("long")).alias("next"))


def dropped_counts(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("split", "reason").agg(F.count(F.lit(1)).alias("n"))


def class_balance(masks: DataFrame, classes: DataFrame) -> DataFrame:
    """Per split and class (zeros included): px, pct of the split's pixels (2 places), tiles, background_tiles.

    masks: split, tile, cls. classes: cls, class_name.
    """
    counts = masks.groupBy("split", "tile", "cls").agg(F.count(F.lit(1)).alias("px"))
    tiles = counts.groupBy("split", "tile").agg(F.max("cls").alias("top"), F.sum("px").alias("all")).groupBy("split").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("top") == 0).alias("background_tiles"), F.greatest(F.sum("all"), F.lit(1)).alias("total"))
    per = counts.groupBy("split", "cls").agg(F.sum("px").alias("px"))
    full = tiles.crossJoin(F.broadcast(classes)).join(per, ["split", "cls"], "left").withColumn("px", F.coalesce("px", F.lit(0)))
    return full.select("split", "cls", "class_name", "px", F.round(100 * F.col("px") / F.col("total"), 2).alias("pct"), "tiles", "background_tiles")


def clip_boxes(regions: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Common part of region boxes and the mosaic's box; empty ones are dropped."""
    cut = {"x0": F.greatest("x0", F.lit(x0)), "y0": F.greatest("y0", F.lit(y0)), "x1": F.least("x1", F.lit(x1)), "y1": F.least("y1", F.lit(y1))}
    return regions.withColumns(cut).filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def clip_rings(regions: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Common part of polygons (``ring``) and the mosaic's box, with the box x0..y1 of what is left; empty ones are dropped."""
    kept = [c for c in regions.columns if c not in ("ring", "x0", "y0", "x1", "y1")]
    return regions.select(*kept, clipped("ring", x0, y0, x1, y1).alias("part")).select(*kept, "part.*").filter("ring is not null")
