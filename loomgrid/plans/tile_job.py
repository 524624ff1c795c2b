"""The tiling job: training tiles (image and mask) of a mosaic, with index, dropped counts and log.

A tile's pixels are found by one equality join on (row, col), for all regions and tiles
at once. Classes are burnt once per pixel of the mosaic, not once per tile.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.geometry import apply_affine, box_ring
from loomgrid.functions.radiometry import stretch
from loomgrid.operators import pixels as P
from loomgrid.operators import tiling as T
from loomgrid.operators.spatial import checkpointed
from loomgrid.plans.integrity import integrity_check
from loomgrid.sources import rasters as RA
from loomgrid.sources import vectors as VE

#: A position of the grid.
PLACE = ("region_id", "r", "c")


@dataclass(frozen=True)
class TileJob:
    """Settings of a job. boundary: "strict" keeps tiles that their region covers, "mask" blackens what lies outside of it."""

    name: str
    transform: tuple
    width: int
    height: int
    tile: int = 1024
    overlap: int = 128
    bands: tuple | None = None
    nodata: float | None = None
    boundary: str = "mask"
    keep_background: bool = False
    drop_nodata: bool = True
    min_coverage: float = 0.5
    stretch: bool = True
    lower: float = 2
    upper: float = 98

    def __post_init__(self) -> None:
        if self.boundary not in ("strict", "mask"):
            raise ValueError(f"unknown boundary mode {self.boundary!r}")
        if not 0 <= self.overlap < self.tile:
            raise ValueError("overlap not below tile size")

    def mosaic(self) -> tuple[float, float, float, float]:
        a, b, c, d, e, f = self.transform
        x = c, a * self.width + b * self.height + c
        y = f, d * self.width + e * self.height + f
        return min(x), min(y), max(x), max(y)

    def cell(self) -> float:
        """Side of a tile in map units, the size of a cell in spatial joins."""
        return abs(self.transform[0]) * self.tile


def positions(job: TileJob, regions: DataFrame) -> DataFrame:
    """All grid positions with box, and ``reason`` where the boundary rules drop one (partial_edge, straddling).

    Training regions have the job's overlap, others none. In mask mode positions beside their region don't count as dropped.
    """
    train = F.col("split") == "train"
    grids = [T.region_grid(regions.filter(c), job.transform, job.width, job.height, job.tile, o) for c, o in ((train, job.overlap), (~train, 0))]
    at = T.tile_boxes(grids[0].unionAll(grids[1]).drop("ring"), job.transform, job.tile).withColumn("tile_id", F.concat_ws("-", *PLACE))
    at = checkpointed(at)
    own = T.inside_own_region(at, regions, job.boundary).select("tile_id", F.lit(True).alias("own"))
    across = T.straddling(at, regions, job.cell()).withColumn("across", F.lit(True))
    judged = at.join(own, "tile_id", "left").join(across, "tile_id", "left")
    reason = F.when(F.col("own").isNull(), "partial_edge").when(F.col("across"), "straddling")
    judged = judged if job.boundary == "strict" else judged.filter("own")
    return judged.withColumn("reason", reason).drop("own", "across", "tile_id")


def _frame(job: TileJob, live: DataFrame, px: DataFrame, regions: DataFrame, polygons: DataFrame, bands: list[int]) -> DataFrame:
    """Every pixel of every tile: place, split, row and col in the tile, values (one a band, in the order asked for), raw_data, mask.

    Beyond the mosaic values and mask are 0.
    """
    chosen = px.filter(F.col("band").isin(bands))
    value = lambda b: F.coalesce(F.max(F.when(F.col("band") == b, F.col("value").cast("double"))), F.lit(0.0))
    pixels = chosen.groupBy("row", "col").agg(F.array(*map(value, bands)).alias("values"))
    x, y = apply_affine(F.col("col") + 0.5, F.col("row") + 0.5, job.transform)
    centres = pixels.select("row", "col", x.alias("x"), y.alias("y"))
    classes = T.pixels_inside(centres, polygons.select("cls", "ring", "x0", "y0", "x1", "y1"), job.cell()).groupBy("row", "col").agg(F.max("cls").alias("mask"))
    pixels = pixels.join(classes, ["row", "col"], "left")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(job.tile**2 - 1).cast("long")))
    spread = live.select(*PLACE, "split", "x_off", "y_off", k.alias("k"))
    spread = spread.select(*PLACE, "split", F.floor(F.col("k") / job.tile).cast("int").alias("trow"), (F.col("k") % job.tile).cast("int").alias("tcol"), "x_off", "y_off")
    spread = spread.withColumns({"row": F.col("y_off") + F.col("trow"), "col": F.col("x_off") + F.col("tcol")}).drop("x_off", "y_off")
    full = spread.join(pixels, ["row", "col"], "left")
    empty = F.lit(0.0 if job.nodata is None else float(job.nodata))
    full = full.withColumn("raw_data", F.coalesce(F.exists("values", lambda v: v != empty), F.lit(False)))
    values = F.coalesce("values", F.array_repeat(F.lit(0.0), len(bands)))
    shown = F.lit(True)
    if job.boundary == "mask":
        inside = T.pixels_inside(centres, regions.select("region_id", "ring", "x0", "y0", "x1", "y1"), job.cell()).withColumn("shown", F.lit(True))
        full, shown = full.join(inside, ["row", "col", "region_id"], "left"), F.coalesce("shown", F.lit(False))
    mask = F.when(shown, F.coalesce("mask", F.lit(0))).otherwise(0)
    values = F.when(shown, values).otherwise(F.array_repeat(F.lit(0.0), len(bands)))
    return full.select(*PLACE, "split", F.col("trow").alias("row"), F.col("tcol").alias("col"), values.alias("values"), "raw_data", mask.cast("int").alias("mask"))


def tile_job(job: TileJob, px: DataFrame, regions: DataFrame, polygons: DataFrame, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tile one mosaic. Tables by name: index, pixels, dropped, regions, stretch.

    px: row, col, band (from 0), value. regions: region_id, split, and ``ring`` or a box x0..y1; a split other than train, val, test
    is an error. polygons: cls, ring, x0..y1 (see sources.vectors.annotations). existing: split, name of tiles from earlier runs,
    after whose numbers the new ones go on.

    index: job_name, split, tile_id, tile_name, has_foreground, region_id, r, c, x0..y1. pixels: split, tile_name, row, col, values,
    mask, a full square for each tile. dropped: reason, n. regions: those used, cut to the mosaic. stretch: band, lo, hi.
    An empty mosaic gives empty tables.
    """
    regions = VE.require_splits(regions)
    if "ring" not in regions.columns:
        regions = regions.withColumn("ring", box_ring("x0", "y0", "x1", "y1"))
    regions = checkpointed(T.clip_rings(regions.select("region_id", "split", "ring"), *job.mosaic()))
    bands = [b - 1 for b in job.bands] if job.bands else sorted(r[0] for r in px.select("band").distinct().collect())  # a raster has few bands
    at = checkpointed(positions(job, regions))
    frame = checkpointed(_frame(job, at.filter("reason is null"), px, regions, polygons, bands))
    empty = F.lit(0.0 if job.nodata is None else float(job.nodata))
    filled = F.sum(F.size(F.filter("values", lambda v: v != empty)))
    facts = frame.groupBy(*PLACE).agg(F.max("raw_data").alias("raw_data"), (filled / (job.tile**2 * max(1, len(bands)))).alias("coverage"), (F.max("mask") > 0).alias("has_foreground"))
    reason = F.col("reason")
    if job.drop_nodata:
        reason = F.coalesce(reason, F.when(~F.col("raw_data"), "nodata"))
    if job.min_coverage > 0:
        reason = F.coalesce(reason, F.when(F.col("coverage") < job.min_coverage, "nodata"))
    if not job.keep_background:
        reason = F.coalesce(reason, F.when(~F.col("has_foreground"), "background_only"))
    judged = checkpointed(at.join(facts, list(PLACE), "left").withColumn("reason", reason))
    kept = judged.filter("reason is null").withColumn("job_name", F.lit(job.name))
    start = F.lit(0)
    if existing is not None:
        own = F.regexp_extract("name", r"^(.*)_tile_\d+", 1) == F.concat_ws("_", F.lit(job.name), "split")
        number = F.regexp_extract("name", r"_tile_(\d+)", 1).cast("long") + 1
        after = existing.filter(own).groupBy("split").agg(F.max(number).alias("after"))  # three splits at most
        kept, start = kept.join(F.broadcast(after), "split", "left"), F.coalesce("after", F.lit(0))
    index = checkpointed(T.number_tiles(kept, start).select("job_name", "split", "tile_id", "tile_name", "has_foreground", *PLACE, "x0", "y0", "x1", "y1"))
    limits = P.percentile_stretch(RA.overview(px.filter(F.col("band").isin(bands)), job.width, job.height), job.lower, job.upper)
    shown = frame.join(index.select(*PLACE, "tile_name"), list(PLACE)).select("split", "tile_name", "row", "col", "values", "mask")
    if job.stretch:
        by = {r["band"]: (r["lo"], r["hi"]) for r in limits.collect()}  # one row a band
        scaled = [stretch(F.col("values")[i], *map(F.lit, by[b])).cast("double") for i, b in enumerate(bands)]
        shown = shown.withColumn("values", F.array(*scaled))
    dropped = judged.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return {"index": index, "pixels": shown, "dropped": dropped, "regions": regions, "stretch": limits}


def balance(pixels: DataFrame, classes: DataFrame) -> DataFrame:
    """Class balance of written masks, background included. classes: cls, class_name."""
    named = classes.select("cls", "class_name").unionAll(classes.sparkSession.createDataFrame([(0, "background")], "cls int, class_name string"))
    return T.class_balance(pixels.select("split", F.col("tile_name").alias("tile"), F.col("mask").alias("cls")), named)


def scan_tiles(spark: SparkSession, folder: str, what: str) -> DataFrame:
    """The images or masks of a folder written by ``write_tiles``: one row a pixel, with split and tile_name."""
    return spark.read.parquet(f"{folder}/{what}")


def write_tiles(job: TileJob, made: dict[str, DataFrame], classes: DataFrame, folder: str, debug: bool = False) -> DataFrame:
    """Write images, masks, tile_index, class_palette and tiling_log below ``folder``, which gets this job's tiles added; returns the log (one JSON text).

    The log is read off the written files: balance, problems found by the integrity check, and this job's settings and dropped counts.
    """
    spark = classes.sparkSession
    dealt = made["pixels"].repartition("split", "tile_name").sortWithinPartitions("split", "tile_name", "row", "col")
    dealt.select("split", "tile_name", "row", "col", "values").write.mode("append").partitionBy("split").parquet(f"{folder}/images")
    dealt.select("split", "tile_name", "row", "col", "mask").write.mode("append").partitionBy("split").parquet(f"{folder}/masks")
    made["index"].write.mode("append").parquet(f"{folder}/tile_index")
    VE.palette_json(classes).write.mode("overwrite").text(f"{folder}/class_palette")
    if debug:
        VE.write_layer(made["regions"], f"{folder}/debug_boundary_{job.name}.geojson", "ring", ["region_id", "split"])
    images, masks = (scan_tiles(spark, folder, k).select("split", F.col("tile_name").alias("stem")).distinct() for k in ("images", "masks"))
    index = spark.read.parquet(f"{folder}/tile_index")
    rows = {
        "class_pixel_balance": balance(scan_tiles(spark, folder, "masks"), classes),
        "problems": integrity_check(images, masks, index, job.cell()),
        "dropped": made["dropped"],
        "tiles": made["index"].groupBy("split").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(~F.col("has_foreground")).alias("background_only")),
        "stretch": made["stretch"],
    }  # a few rows each: per split and class, reason, or band
    log = spark.createDataFrame([(json.dumps(asdict(job)),)], "config string")
    for name, table in rows.items():
        log = log.crossJoin(table.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*table.columns)))).alias(name)))
    text = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{c}": '), F.col(c)) for c in ["config", *rows]]), F.lit("}"))
    log = checkpointed(log.select(text.alias("value")))
    log.write.mode("overwrite").text(f"{folder}/tiling_log_{job.name}")
    return log
