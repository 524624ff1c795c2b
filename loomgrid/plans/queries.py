"""Registered queries of the raster and layer operators, each beside its SQL.

"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions import geometry as G
from loomgrid.functions import radiometry as R
from loomgrid.operators import batch as BA
from loomgrid.operators import instances as I
from loomgrid.operators import pixels as P
from loomgrid.operators import seeds as S
from loomgrid.operators import spatial as SP
from loomgrid.operators import tiling as T
from loomgrid.operators import validate as V
from loomgrid.plans import models as M
from loomgrid.plans.extract import extract
from loomgrid.plans.tile_job import TileJob, tile_job
from loomgrid.plans.views import Views, with_views
from loomgrid.sources import rasters as RA
from loomgrid.sources import vectors as VE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Transform of the examples: 0.31 m pixels, north up.
GEO = (0.31, 0.0, 400000.0, 0.0, -0.31, 2700000.0)


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register a function of Views under ``name``, with its SQL over the named views."""

    def add(f: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql
        return f

    return add


# Scans

@query("s1_read_window", """, frame AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(b AS INT) AS band FROM range(-2, 14) a(r), range(10, 26) d(c), range(8) e(b)),
v AS (SELECT f.row, f.col, f.band, coalesce(ms.value, 0.0::DOUBLE) AS value FROM frame f LEFT JOIN ms USING (row, col, band))
SELECT row, col, band, value, bool_or(value <> 120) OVER (PARTITION BY row, col) AS valid FROM v""", "ms")
def s1(v):
    return RA.read_window(v.ms(), -2, 10, 16, 120.0)


@query("s2_read_tile", """, frame AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(b AS INT) AS band FROM range(12) a(r), range(12) d(c), (VALUES (0), (2)) e(b)),
inside AS (SELECT row - 8 AS row, col - 14 AS col, band, value FROM ms WHERE row BETWEEN 8 AND 19 AND col BETWEEN 14 AND 25 AND band IN (0, 2))
SELECT f.row, f.col, f.band, coalesce(i.value, 0.0::DOUBLE) AS value, (SELECT coalesce(bool_or(value <> 0), false) FROM inside) AS has_data
FROM frame f LEFT JOIN inside i USING (row, col, band)""", "ms")
def s2(v):
    return RA.read_tile(v.ms(), 8, 14, 12, [1, 3], None)


@query("s3_s4_pixel_vectors", """SELECT row, col, string_agg(CAST(CAST(value AS INT) AS VARCHAR), ',' ORDER BY band) AS bands,
(SELECT max(row) + 1 FROM ms) AS height, (SELECT max(col) + 1 FROM ms) AS width FROM ms GROUP BY row, col""", "ms")
def s3(v):
    out = RA.pixel_vectors(v.ms())
    return out.withColumn("bands", F.array_join(F.transform("bands", lambda x: x.cast("int").cast("string")), ","))


@query("s5_label_and_heatmap", """SELECT scene, CAST(max(row) - min(row) + 1 AS BIGINT) AS height, CAST(max(col) - min(col) + 1 AS BIGINT) AS width, count(*) AS pixels,
count(*) = (max(row) - min(row) + 1) * (max(col) - min(col) + 1) AS "full" FROM px GROUP BY scene""", "px")
def s5(v):
    return V.grid_facts(v.px())


@query("s7_annotations", """SELECT class_name, id, round((x1 - x0) * (y1 - y0), 6) AS area, cls FROM crown JOIN classes USING (class_name) WHERE (x1 - x0) * (y1 - y0) >= 1""", "crown classes")
def s7(v):
    c = v.crown().withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    padded = c.withColumn("class_name", F.concat(F.lit("  "), "class_name", F.lit(" ")))
    out = VE.annotations([padded.filter("id % 2 = 0"), c.filter("id % 2 = 1")], v.classes(), 1.0)
    return out.select("class_name", "id", F.round("area", 6).alias("area"), "cls")


@query("s8_split_regions", "SELECT region_id, lower(trim(split)) AS split, x0, y0, x1, y1 FROM reg", "region")
def s8(v):
    return VE.require_splits(v.region())


@query("s9_list_rasters", "SELECT DISTINCT name FROM names WHERE regexp_matches(name, '(\\.tif|\\.tiff|\\.TIF|\\.TIFF)$') ORDER BY name", "names")
def s9(v):
    return RA.list_rasters(v.names())


@query("s9_list_by_pattern", "SELECT DISTINCT name FROM names WHERE regexp_matches(name, '^.*_label\\..*$') ORDER BY name", "names")
def s9b(v):
    return RA.list_rasters(v.names(), "*_label.*")


@query("s10_split_listing", """SELECT CASE CAST(regexp_extract(name, '(\\d+)', 1) AS INT) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split,
regexp_extract(name, '([^/]*?)(\\.[^./]*)?$', 1) AS stem, count(*) AS n FROM names GROUP BY ALL""", "names")
def s10(v):
    k = F.regexp_extract("name", r"(\d+)", 1).cast("int") % 3
    split = F.when(k == 0, "train").when(k == 1, "val").otherwise("test")
    return v.names().groupBy(split.alias("split"), RA.stem(F.col("name")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


@query("s12_overview", "SELECT row, col, band, value FROM ms WHERE row % 3 = 0 AND col % 3 = 0", "ms")
def s12(v):
    return RA.overview(v.ms(), 20, 25, 6)


@query("s13_demo_scene", """WITH b AS (SELECT CAST(p_partkey * 37 % 128 AS DOUBLE) AS y, CAST(p_partkey * 53 % 128 AS DOUBLE) AS x, 3.0::DOUBLE + p_size % 7 AS radius FROM part),
g AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM range(128) a(r), range(128) d(c))
SELECT row, col, round(coalesce(max(greatest(0.0::DOUBLE, 1 - sqrt((row - y) ** 2 + (col - x) ** 2) / radius)), 0.0), 6) AS p,
CAST(coalesce(max(greatest(0.0::DOUBLE, 1 - sqrt((row - y) ** 2 + (col - x) ** 2) / radius)), 0.0) > 0.3 AS INT) AS label FROM g, b GROUP BY row, col""")
def s13(v):
    k = F.col("p_partkey")
    blobs = v.table("part").select((k * 37 % 128).cast("double").alias("row"), (k * 53 % 128).cast("double").alias("col"), (3.0 + F.col("p_size") % 7).alias("radius"))
    return RA.demo_scene(v.spark, 128, blobs).withColumn("p", F.round("p", 6))


# Sinks that are rows

@query("k5_batch_rows", "SELECT CASE status WHEN 'ok' THEN 0 WHEN 'skipped' THEN 1 ELSE 2 END AS rank, file, status, tree_count, error FROM files", "files")
def k5(v):
    return VE.batch_rows(v.files())


@query("k3_geojson_round_trip", """SELECT id, class_name, 5 AS points, x0 AS first_x, y1 AS last_corner_y FROM crown""", "crown")
def k3(v):
    ring = v.crown().withColumn("ring", G.box_ring("x0", "y0", "x1", "y1"))
    text = VE.geojson(ring, "ring", ["id", "class_name"])
    schema = "properties struct<id: long, class_name: string>, geometry struct<type string, coordinates array<array<array<double>>>>"
    c = text.select(F.from_json("value", schema).alias("f")).select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("c"))
    return c.select("id", "class_name", F.size("c").alias("points"), F.col("c")[0][0].alias("first_x"), F.col("c")[3][1].alias("last_corner_y"))


# Projections, filters, predicates

@query("f1_palm_mask", ", f AS (SELECT max(cls) AS top, bool_or(cls = 7) AS has FROM px) SELECT scene, row, col, cls, cls = CASE WHEN NOT has AND top = 1 THEN 1 ELSE 7 END AS palm FROM px, f", "px")
def f1(v):
    return P.palm_mask(v.px().drop("palm", "p"), 7)


@query("f1_palm_mask_binary", "SELECT scene, row, col, CAST(palm AS INT) AS cls, palm FROM px", "px")
def f1b(v):
    return P.palm_mask(v.px().select("scene", "row", "col", F.col("palm").cast("int").alias("cls")), 7)


@query("f2_empty_masks", "SELECT scene, string_agg(DISTINCT CAST(cls AS VARCHAR), ',' ORDER BY CAST(cls AS VARCHAR)) AS classes FROM px GROUP BY scene HAVING NOT bool_or(cls = 9)", "px")
def f2(v):
    return P.empty_masks(v.px(), 9).withColumn("classes", F.array_join(F.transform("classes", lambda c: c.cast("string")), ","))


@query("f3_threshold", "SELECT row, col, CASE WHEN p > 0.5 THEN p ELSE 0 END AS p FROM px", "px")
def f3(v):
    return P.threshold(v.px(), 0.5).select("row", "col", "p")


#: Solid rectangles of w x h pixels, one a part, with their contours (through pixel centres).
_BLOCKS = """WITH b AS (SELECT p_partkey + 1 AS inst, 1 + p_size % 9 AS w, 2 + p_partkey % 7 AS h FROM part),
t AS (SELECT CAST(inst AS INT) AS inst, w, h, CAST(w * h AS BIGINT) AS n_px, (w - 1) * (h - 1)::DOUBLE AS area, 2.0::DOUBLE * (w + h - 2) AS around FROM b),
k AS (SELECT *, 4 * pi() * area / (around * around) AS circ FROM t WHERE n_px >= 4 AND area >= 4 AND 4 * pi() * area / (around * around) >= 0.5)"""


def _blocks(v):
    """Pixels of one rectangle for each part: scene, inst, row, col, palm."""
    b = v.table("part").select((F.col("p_partkey") + 1).cast("int").alias("inst"), (1 + F.col("p_size") % 9).cast("int").alias("w"), (2 + F.col("p_partkey") % 7).cast("int").alias("h"))
    cells = b.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    return cells.select(F.lit("s").alias("scene"), "inst", (F.col("inst") * 10 + F.col("y")).alias("row"), F.col("x").alias("col"), "y", "x", "w", "h")


def _block_trees(v):
    return I.trees(_blocks(v).select("scene", "inst", "row", "col", (F.col("x") * 0.0 + 0.25).alias("p")), "p", 4, 0.5)


@query("f4_f5_min_area_circularity", _BLOCKS + " SELECT inst, n_px, area AS area_px, round(circ, 6) AS circularity FROM k")
def f4(v):
    return _block_trees(v).select("inst", "n_px", "area_px", F.round("circularity", 6).alias("circularity"))


@query("a4_block_contours", _BLOCKS + " SELECT inst, area AS area_px, around AS perimeter FROM t")
def a4_blocks(v):
    return I.contours(_blocks(v)).select("inst", "area_px", "perimeter")


@query("b8_block_crowns", _BLOCKS + """ SELECT row_number() OVER (ORDER BY inst) - 1 AS id, 0.25::DOUBLE AS score, round(circ, 4) AS circularity, round(2 * sqrt(area * (0.31::DOUBLE * 0.31::DOUBLE) / pi()), 3) AS diam_m,
round(area, 1) AS area_px, round(64 / 2.0::DOUBLE * sin(2 * pi() / 64) * area / pi() * 0.31::DOUBLE * 0.31::DOUBLE, 4) AS ring_area FROM k""")
def b8_blocks(v):
    return I.crowns(_block_trees(v), GEO).withColumn("ring_area", F.round(G.ring_area("ring"), 4)).drop("scene", "ring")


@query("b5_b7_block_polygons", _BLOCKS + " SELECT row_number() OVER (ORDER BY inst) - 1 AS id, 5 AS corners, round(area * 0.31::DOUBLE * 0.31::DOUBLE, 4) AS ring_area FROM k")
def b7_blocks(v):
    layer = I.crowns(_block_trees(v), GEO, "polygon")
    return layer.select("id", F.size("ring").alias("corners"), F.round(G.ring_area("ring"), 4).alias("ring_area"))


_HOLED = "w >= 3 AND h >= 3 AND inst % 2 = 0"


@query("a8_block_polygons", f"{_BLOCKS} SELECT CAST(inst AS VARCHAR) AS scene, w * h - CASE WHEN {_HOLED} THEN 1 ELSE 0 END::DOUBLE AS area, 5 AS corners, CASE WHEN {_HOLED} THEN 1 ELSE 0 END AS holes FROM t")
def a8_blocks(v):
    px = _blocks(v).filter(f"not ({_HOLED} and x = 1 and y = 1)").select(F.col("inst").cast("string").alias("scene"), "row", "col", F.lit(1).alias("cls"))
    return I.mask_polygons(px).select("scene", "area", F.size("ring").alias("corners"), F.size("holes").alias("holes"))


@query("a6_a7_block_seeds", """WITH b AS (SELECT CAST(p_partkey + 1 AS INT) AS inst, 1 + p_size % 9 AS w, 2 + p_partkey % 7 AS h FROM part)
SELECT CAST(inst AS VARCHAR) AS scene, CAST(inst * 10 + CASE WHEN w = 3 AND h = 3 THEN 0 ELSE round_even((h - 1) / 2.0::DOUBLE, 0) END AS INT) AS row, CAST(round_even((w - 1) / 2.0::DOUBLE, 0) AS INT) AS col FROM b""")
def a6_blocks(v):
    # The 3 x 3 blocks lack their middle, so the centroid is snapped to the first of the four pixels beside it.
    peaks = _blocks(v).filter("not (w = 3 and h = 3 and x = 1 and y = 1)").select(F.col("inst").cast("string").alias("scene"), "row", "col")
    return S.plateau_seeds(peaks).select("scene", "row", "col")


@query("w5_valley", """WITH s AS (SELECT p_partkey AS k, 6 + p_size % 9 AS n, p_partkey % 3 AS m FROM part)
SELECT CAST(k AS VARCHAR) AS scene, CAST(c AS INT) AS col, CASE WHEN c <= m + 1 THEN 1 ELSE 2 END AS inst FROM s, unnest(range(0, n)) u(c)""")
def w5_valley(v):
    # Strips with a seed at either end; their heatmap falls to a valley just right of column m + 1, where the floods meet.
    s = v.table("part").select(F.col("p_partkey").cast("string").alias("scene"), (6 + F.col("p_size") % 9).alias("n"), (F.col("p_partkey") % 3).alias("m"))
    px = s.withColumn("col", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).withColumn("row", F.lit(0)).withColumn("palm", F.lit(True)).withColumn("p", F.abs(F.col("col") - F.col("m") - 1.3))
    ends = px.filter("col = 0 or col = n - 1").select("scene", "row", "col", F.when(F.col("col") == 0, 1).otherwise(2).alias("seed_id"))
    return I.assign_watershed(px.select("scene", "row", "col", "palm", "p"), ends).select("scene", "col", "inst")


@query("f6_class_filter", "SELECT row, col FROM px WHERE cls = 2", "px")
def f6(v):
    return v.px().filter("cls = 2").select("row", "col")


@query("f7_live_tiles", """, t AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, p FROM px, range(0, 100000, 6) a(y), range(0, 50, 6) b(x) WHERE row BETWEEN y AND y + 7 AND col BETWEEN x AND x + 7)
SELECT y, x FROM t GROUP BY y, x HAVING bool_or(p > 0.95)""", "px")
def f7(v):
    return P.live_tiles(P.to_tiles(v.px().withColumn("valid", F.col("p") > 0.95), 8, 2))


@query("f8_tiles_with_data", "SELECT row // 5 AS r, col // 5 AS c FROM ms WHERE band = 1 GROUP BY ALL HAVING bool_or(value <> 255)", "ms")
def f8(v):
    t = v.ms().filter("band = 1").withColumns({"r": F.floor(F.col("row") / 5).cast("int"), "c": F.floor(F.col("col") / 5).cast("int")})
    return T.tiles_with_data(t, 255.0, ["r", "c"])


@query("f9_coverage", "SELECT row // 5 AS r, col // 5 AS c, round(count(*) FILTER (WHERE value > 100) / count(*)::DOUBLE, 6) AS coverage FROM ms GROUP BY ALL HAVING count(*) FILTER (WHERE value > 100) / count(*)::DOUBLE >= 0.7", "ms")
def f9(v):
    t = v.ms().withColumns({"r": F.floor(F.col("row") / 5).cast("int"), "c": F.floor(F.col("col") / 5).cast("int"), "value": F.when(F.col("value") > 100, F.col("value")).otherwise(0)})
    return T.covered_tiles(t, None, 0.7, ["r", "c"]).withColumn("coverage", F.round("coverage", 6))


@query("f10_foreground_tiles", "SELECT row // 2 AS r, col // 2 AS c FROM px GROUP BY ALL HAVING max(cls) > 0", "px")
def f10(v):
    t = v.px().select(F.floor(F.col("row") / 2).cast("int").alias("r"), F.floor(F.col("col") / 2).cast("int").alias("c"), F.col("cls").alias("mask"))
    return T.foreground_tiles(t, ["r", "c"])


@query("f11_bands", "SELECT row, col, band, value FROM ms WHERE band + 1 IN (2, 5, 8)", "ms")
def f11(v):
    return RA.select_bands(v.ms(), [2, 5, 8])


@query("f12_reverse_channels", "SELECT row, col, 2 - band AS band, value FROM ms WHERE band < 3", "ms")
def f12(v):
    return RA.reverse_channels(v.ms().filter("band < 3"), "rgb", 3)


@query("f13_blacken", "SELECT row, col, band, CASE WHEN (row - 12) * (row - 12) + (col - 10) * (col - 10) <= 64 THEN value ELSE 0 END AS value FROM ms", "ms")
def f13(v):
    inside = (F.col("row") - 12) ** 2 + (F.col("col") - 10) ** 2 <= 64
    return T.blacken(v.ms().withColumn("inside", inside), "inside").drop("inside")


@query("f14_f15_empty_geometries", "SELECT id FROM crown WHERE x1 > x0 AND y1 > y0 AND x1 <= 45", "crown")
def f14(v):
    c = v.crown().withColumns({"x1": F.when(F.col("x1") <= 45, F.col("x1")).otherwise(F.col("x0"))})
    return T.clip_boxes(c, -1e9, -1e9, 1e9, 1e9).select("id")


# Joins

@query("j1_pair_heatmaps", """, l AS (SELECT DISTINCT name, regexp_replace(regexp_extract(name, '([^/]*?)(\\.[^./]*)?$', 1), '_label$', '') AS stem FROM names WHERE name LIKE '%\\_label.%' ESCAPE '\\'),
h AS (SELECT DISTINCT name AS heatmap, regexp_replace(regexp_extract(name, '([^/]*?)(\\.[^./]*)?$', 1), '_prob$', '') AS stem FROM names WHERE name LIKE '%\\_prob.%' ESCAPE '\\')
SELECT stem, name, heatmap FROM l LEFT JOIN h USING (stem)""", "names")
def j1(v):
    n = v.names().distinct()
    return BA.pair_heatmaps(n.filter("name like '%\\\\_label.%'"), n)


@query("j2_pixel_join", "SELECT a.row, a.col, a.cls, b.value FROM px a JOIN ms b ON a.row = b.row AND a.col = b.col AND b.band = 0", "px ms")
def j2(v):
    return v.px().select("row", "col", "cls").join(v.ms().filter("band = 0").drop("band"), ["row", "col"])


@query("j3_unpaired", """WITH m AS (SELECT doc_id AS stem FROM labels UNION SELECT -1 - doc_id FROM labels WHERE doc_id < 50), i AS (SELECT doc_id AS stem FROM documents),
u AS (SELECT DISTINCT stem, 'image without mask' AS side FROM i WHERE stem NOT IN (SELECT stem FROM m) UNION ALL SELECT DISTINCT stem, 'mask without image' FROM m WHERE stem NOT IN (SELECT stem FROM i)),
k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY stem) AS k FROM u)
SELECT side, count(*) AS n, string_agg(CAST(stem AS VARCHAR), ',' ORDER BY stem) FILTER (WHERE k <= 3) AS examples FROM k GROUP BY side""")
def j3(v):
    labels = v.table("labels").select("doc_id")
    masks = labels.select(F.col("doc_id").alias("stem")).unionAll(labels.filter("doc_id < 50").select((-1 - F.col("doc_id")).alias("stem")))
    out = V.unpaired(v.table("documents").select(F.col("doc_id").alias("stem")), masks)
    return out.withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


_TILES = ", t AS (SELECT id AS tile_id, CASE id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, CAST(floor(x0 / 10) AS INT) AS region_id, x0, y0, x1, y1 FROM crown)"


def _tiles(v):
    split = F.when(F.col("id") % 3 == 0, "train").when(F.col("id") % 3 == 1, "val").otherwise("test")
    return v.crown().select(F.col("id").alias("tile_id"), split.alias("split"), F.floor(F.col("x0") / 10).cast("int").alias("region_id"), "x0", "y0", "x1", "y1")


@query("j4_split_overlaps", _TILES + """ SELECT a.split AS split_a, b.split AS split_b, count(*) AS pairs FROM t a JOIN t b ON a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0
WHERE (a.split, b.split) IN (('train', 'val'), ('train', 'test'), ('val', 'test')) GROUP BY ALL""", "crown")
def j4(v):
    return T.split_overlaps(_tiles(v), 2.0)


@query("j5_candidates", _TILES + """, n AS (SELECT id AS annot_id, CAST(id % 4 AS INT) AS cls, x0 + 0.3::DOUBLE AS x0, y0 + 0.3::DOUBLE AS y0, x1 + 0.1::DOUBLE AS x1, y1 + 0.1::DOUBLE AS y1 FROM crown)
SELECT tile_id, annot_id, cls FROM t JOIN n ON t.x0 <= n.x1 AND t.x1 >= n.x0 AND t.y0 <= n.y1 AND t.y1 >= n.y0""", "crown")
def j5(v):
    n = v.crown().select(F.col("id").alias("annot_id"), (F.col("id") % 4).cast("int").alias("cls"), (F.col("x0") + 0.3).alias("x0"), (F.col("y0") + 0.3).alias("y0"), (F.col("x1") + 0.1).alias("x1"), (F.col("y1") + 0.1).alias("y1"))
    return T.candidates(_tiles(v), n, 2.0)


@query("j6_reject_straddling", _TILES + """ SELECT tile_id, split, region_id FROM t WHERE NOT EXISTS (SELECT 1 FROM reg r WHERE r.region_id <> t.region_id
AND greatest(0, least(t.x1, r.x1) - greatest(t.x0, r.x0)) * greatest(0, least(t.y1, r.y1) - greatest(t.y0, r.y0)) > 1e-6::DOUBLE * ((t.x1 - t.x0) * (t.y1 - t.y0)))""", "crown region")
def j6(v):
    return T.reject_straddling(_tiles(v), v.region(), 5.0).select("tile_id", "split", "region_id")


@query("j7_inside_own_region", _TILES + " SELECT tile_id FROM t JOIN reg r USING (region_id) WHERE t.x0 >= r.x0 AND t.y0 >= r.y0 AND t.x1 <= r.x1 AND t.y1 <= r.y1", "crown region")
def j7(v):
    return T.inside_own_region(_tiles(v), v.region()).select("tile_id")


@query("j7_meets_own_region", _TILES + " SELECT tile_id FROM t JOIN reg r USING (region_id) WHERE t.x0 <= r.x1 AND t.x1 >= r.x0 AND t.y0 <= r.y1 AND t.y1 >= r.y0", "crown region")
def j7b(v):
    return T.inside_own_region(_tiles(v), v.region(), "mask").select("tile_id")


_SEEDS = ", sd AS (SELECT CAST(row * 50 + col + 1 AS INT) AS seed_id, row, col, p AS strength FROM px WHERE p > 0.9)"


def _seeds(v):
    return v.px().filter("p > 0.9").select((F.col("row") * 50 + F.col("col") + 1).cast("int").alias("seed_id"), "row", "col", F.col("p").alias("strength"))


@query("j8_voronoi", _SEEDS + """, d AS (SELECT m.row, m.col, s.seed_id, CAST((m.row - s.row) ** 2 + (m.col - s.col) ** 2 AS DOUBLE) AS d2 FROM px m, sd s WHERE m.palm)
SELECT row, col, CAST(arg_min(seed_id, d2 * 1e9::DOUBLE + seed_id) AS INT) AS inst, min(d2) AS d2 FROM d GROUP BY row, col""", "px")
def j8(v):
    return I.assign_voronoi(v.px().filter("palm").select("row", "col"), _seeds(v), 4)


@query("j9_radius_pairs", _SEEDS + " SELECT a.seed_id AS a, b.seed_id AS b FROM sd a JOIN sd b ON a.seed_id < b.seed_id AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 4", "px")
def j9(v):
    return SP.radius_pairs(_seeds(v).select(F.col("seed_id").alias("id"), F.col("col").alias("x"), F.col("row").alias("y")), 2)


_IOU = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_AREA = "(a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)"


@query("j10_iou_pairs", f"SELECT a.id AS a, b.id AS b, round({_IOU} / ({_AREA} - {_IOU}), 6) AS iou FROM crown a JOIN crown b ON a.id < b.id AND a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 WHERE {_IOU} / ({_AREA} - {_IOU}) >= 0.3", "crown")
def j10(v):
    c = v.crown()
    pairs = SP.box_pairs(c, c, 2.0).filter((F.col("a.id") < F.col("b.id")) & (G.box_iou("a", "b") >= 0.3))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(G.box_iou("a", "b"), 6).alias("iou"))


@query("j11_markers", _SEEDS + " SELECT px.row, px.col, coalesce(seed_id, 0) AS marker FROM px LEFT JOIN sd USING (row, col) WHERE palm", "px")
def j11(v):
    return v.px().filter("palm").select("row", "col").join(_seeds(v), ["row", "col"], "left").select("row", "col", F.coalesce("seed_id", F.lit(0)).alias("marker"))


@query("j12_seed_strength", _SEEDS + " SELECT seed_id, p AS score FROM sd JOIN px USING (row, col)", "px")
def j12(v):
    return _seeds(v).select("seed_id", "row", "col").join(v.px().select("row", "col", F.col("p").alias("score")), ["row", "col"]).select("seed_id", "score")


@query("j13_class_lookup", "SELECT id, cls FROM crown JOIN classes USING (class_name)", "crown classes")
def j13(v):
    return v.crown().join(F.broadcast(v.classes()), "class_name").select("id", "cls")


@query("j14_clip_regions", "SELECT region_id, greatest(x0, 5) AS x0, greatest(y0, 3) AS y0, least(x1, 37.5::DOUBLE) AS x1, least(y1, 33) AS y1 FROM reg WHERE least(x1, 37.5::DOUBLE) > greatest(x0, 5)", "region")
def j14(v):
    return T.clip_boxes(v.region(), 5.0, 3.0, 37.5, 33.0).drop("split")


@query("j15_resolve_models", "SELECT * FROM (VALUES ('segformer_b3_ms', 'ms', 'segformer', true), ('mask2former_swin_t_rgb', 'rgb', 'mask2former', false)) t(model_id, modality, family, heatmap_capable)")
def j15(v):
    return M.resolve(v.spark.createDataFrame([("segformer_b3_ms",), ("mask2former_swin_t_rgb",), ("unheard_of",)], "model_id string"))


# Aggregations

_RAMP = lambda d: f"CASE WHEN {d} >= 6 THEN 0.1::DOUBLE + (7 - {d}) * 0.9::DOUBLE WHEN {d} < 2 THEN 0.1::DOUBLE + {d} * 0.9::DOUBLE ELSE 1 END"
_BLEND = f""", t AS (SELECT y, x, row, col, CASE k WHEN 0 THEN 1 - p ELSE p * (1 + 0.01::DOUBLE * ((y // 6) % 3)) END AS p, CAST(k AS INT) AS cls, p > 0.05 AS valid
  FROM px, range(0, 100000, 6) a(y), range(0, 50, 6) b(x), range(2) c(k) WHERE row BETWEEN y AND y + 7 AND col BETWEEN x AND x + 7),
w AS (SELECT *, CASE WHEN valid THEN ({_RAMP("(row - y)")}) * ({_RAMP("(col - x)")}) ELSE 0 END AS w FROM t),
bl AS (SELECT row, col, cls, CASE WHEN sum(w) > 0 THEN sum(p * w) / sum(w) ELSE 0 END AS p FROM w GROUP BY row, col, cls)"""


def _scored(v):
    tiled = P.to_tiles(v.px().select("row", "col", "p"), 8, 2)
    k = F.explode(F.array(F.lit(0), F.lit(1)))
    value = F.when(F.col("cls") == 0, 1 - F.col("p")).otherwise(F.col("p") * (1 + 0.01 * (F.floor(F.col("y") / 6) % 3)))
    return tiled.withColumn("valid", F.col("p") > 0.05).withColumn("cls", k).withColumn("p", value)


@query("a1_w6_w7_blend", _BLEND + " SELECT row, col, cls, round(p, 9) AS p FROM bl", "px")
def a1(v):
    return P.blend(_scored(v), 8, 2).withColumn("p", F.round("p", 9))


@query("a2_decide", _BLEND + " SELECT row, col, CAST(arg_max(cls, round(p, 9) * 10 - cls * 1e-9::DOUBLE) AS INT) AS cls, round(max(p), 9) AS p FROM bl GROUP BY row, col", "px")
def a2(v):
    # Probabilities that agree to nine places tie, as the SQL has it.
    return P.decide(P.blend(_scored(v), 8, 2).withColumn("p", F.round("p", 9)))


_INST = ", i AS (SELECT 's' AS scene, row, col, CAST(row // 4 * 13 + col // 4 + 1 AS INT) AS inst, p FROM px WHERE palm)"


def _instances(v):
    inst = F.floor(F.col("row") / 4) * 13 + F.floor(F.col("col") / 4) + 1
    return v.px().filter("palm").select("scene", "row", "col", inst.cast("int").alias("inst"), "p")


@query("a3_instance_stats", _INST + " SELECT scene, inst, count(*) AS n_px, round(avg(row), 6) AS cy, round(avg(col), 6) AS cx, round(avg(p), 6) AS confidence FROM i GROUP BY scene, inst", "px")
def a3(v):
    return I.instance_stats(_instances(v)).select("scene", "inst", "n_px", *[F.round(c, 6).alias(c) for c in ("cy", "cx", "confidence")])


@query("a4_contours")
def a4(v):
    return I.contours(_instances(v)).drop("ring")


@query("a5_components", """, m AS (SELECT row, col, row * 50 + col AS id FROM px WHERE palm AND p > 0.3), e AS (SELECT a.id AS a, b.id AS b FROM m a, range(-1, 2) r(dr), range(-1, 2) c(dc), m b WHERE b.row = a.row + dr AND b.col = a.col + dc),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT row, col, CAST(least // 50 AS INT) AS first_row, CAST(least % 50 AS INT) AS first_col FROM m JOIN reach ON id = a""", "px")
def a5(v):
    c = S.components(v.px().filter("palm and p > 0.3").select("scene", "row", "col"), 2)
    return c.select("row", "col", F.floor(F.col("comp") / (1 << 31)).cast("int").alias("first_row"), (F.col("comp") % (1 << 31)).cast("int").alias("first_col"))


@query("a6_a7_plateau_seeds")
def a6(v):
    return S.plateau_seeds(v.px().filter("palm and p > 0.4").select("scene", "row", "col"))


@query("a8_mask_polygons")
def a8(v):
    out = I.mask_polygons(v.px(), 1, GEO)
    return out.select("scene", "comp", "area", F.size("ring").alias("corners"), F.size("holes").alias("holes"))


@query("a9_class_balance", """, m AS (SELECT CASE (row // 10) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, row // 5 * 10 + col // 5 AS tile, CASE WHEN (row // 5) % 4 = 0 THEN 0 ELSE cls END AS cls FROM px),
c AS (SELECT * FROM (VALUES (1, 'palm'), (2, 'shrub'), (3, 'none')) t(cls, class_name)), tl AS (SELECT split, tile, max(cls) AS top, count(*) AS n FROM m GROUP BY ALL),
s AS (SELECT split, count(*) AS tiles, count(*) FILTER (WHERE top = 0) AS background_tiles, CAST(sum(n) AS BIGINT) AS total FROM tl GROUP BY split)
SELECT s.split, c.cls, class_name, count(m.cls) AS px, round(100 * count(m.cls) / total::DOUBLE, 2) AS pct, tiles, background_tiles
FROM s CROSS JOIN c LEFT JOIN m ON m.split = s.split AND m.cls = c.cls GROUP BY s.split, c.cls, class_name, total, tiles, background_tiles""", "px")
def a9(v):
    band = F.floor(F.col("row") / 10) % 3
    split = F.when(band == 0, "train").when(band == 1, "val").otherwise("test")
    masks = v.px().select(split.alias("split"), (F.floor(F.col("row") / 5) * 10 + F.floor(F.col("col") / 5)).alias("tile"), F.when(F.floor(F.col("row") / 5) % 4 == 0, 0).otherwise(F.col("cls")).alias("cls"))
    classes = v.spark.createDataFrame([(1, "palm"), (2, "shrub"), (3, "none")], "cls int, class_name string")
    return T.class_balance(masks, classes)


@query("a10_o6_value_histogram", "SELECT value, count(DISTINCT mask) AS masks FROM (SELECT row AS mask, CAST(floor(p * 20) AS BIGINT) AS value FROM px) GROUP BY value ORDER BY masks DESC, value LIMIT 6", "px")
def a10(v):
    return V.value_histogram(v.px().select(F.col("row").alias("mask"), F.floor(F.col("p") * 20).alias("value")))


_STRETCH = """, q AS (SELECT band, quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM ms WHERE value > 0 GROUP BY band),
st AS (SELECT band, a AS lo, CASE WHEN b - a < 1 THEN a + 1 ELSE b END AS hi FROM q)"""


@query("a11_percentile_stretch", _STRETCH + " SELECT band, round(lo, 6) AS lo, round(hi, 6) AS hi FROM st", "ms")
def a11(v):
    return P.percentile_stretch(v.ms()).select("band", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("a12_batch_totals", """SELECT count(*) FILTER (WHERE status = 'ok') AS processed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed,
CAST(coalesce(sum(tree_count), 0) AS BIGINT) AS trees FROM files""", "files")
def a12(v):
    return BA.totals(v.files())


@query("a13_dropped_counts", "SELECT split, CASE WHEN p < 0.3 THEN 'nodata' ELSE 'coverage' END AS reason, count(*) AS n FROM (SELECT CASE row % 2 WHEN 0 THEN 'train' ELSE 'val' END AS split, p FROM px WHERE p < 0.5) GROUP BY ALL", "px")
def a13(v):
    t = v.px().filter("p < 0.5").select(F.when(F.col("row") % 2 == 0, "train").otherwise("val").alias("split"), F.when(F.col("p") < 0.3, "nodata").otherwise("coverage").alias("reason"))
    return T.dropped_counts(t)


@query("a14_counts_per_class", "SELECT cls, count(*) AS n FROM crown JOIN classes USING (class_name) GROUP BY cls", "crown classes")
def a14(v):
    return v.crown().join(F.broadcast(v.classes()), "class_name").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query("a15_next_index", "SELECT max(event_id % 700) + 1 AS next FROM events")
def a15(v):
    return T.next_index(v.table("events").select(F.format_string("job_train_tile_%06d.tif", F.col("event_id") % 700).alias("name")))


@query("a16_crs_count", "SELECT count(DISTINCT c_mktsegment) AS n, count(DISTINCT c_mktsegment) > 1 AS mixed FROM customer")
def a16(v):
    return V.crs_count(v.table("customer").select(F.col("c_mktsegment").alias("crs")))


@query("a17_repeated_names", "SELECT name, ord FROM (SELECT p_name AS name, p_partkey AS ord, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) WHERE k > 1")
def a17(v):
    return V.repeated(v.table("part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord")), "name", "ord")


@query("a18_repeated_values", "SELECT count(DISTINCT p_size) <> count(p_size) AS repeated FROM part")
def a18(v):
    return V.repeated_values(v.table("part"), "p_size")


_PAIRS = ", g AS (SELECT cls AS gt, CASE WHEN p > 0.8 THEN (cls + 1) % 3 ELSE cls END AS pred FROM px)"
_SCORES = _PAIRS + """, s AS (SELECT k AS cls, count(*) FILTER (WHERE gt = k AND pred = k) AS tp, count(*) FILTER (WHERE gt = k) + count(*) FILTER (WHERE pred = k) AS met FROM g, range(3) r(k) GROUP BY k),
sc AS (SELECT CAST(cls AS INT) AS cls, 100 * tp / (met - tp)::DOUBLE AS iou, 200 * tp / met::DOUBLE AS fscore FROM s)"""


def _pairs(v):
    return v.px().select(F.col("cls").alias("gt"), F.when(F.col("p") > 0.8, (F.col("cls") + 1) % 3).otherwise(F.col("cls")).alias("pred"))


@query("a19_class_scores", _SCORES + " SELECT cls, round(iou, 6) AS iou, round(fscore, 6) AS fscore FROM sc", "px")
def a19(v):
    return P.class_scores(_pairs(v)).select("cls", F.round("iou", 6).alias("iou"), F.round("fscore", 6).alias("fscore"))


@query("a19_mean_scores", _SCORES + " SELECT round(avg(iou), 6) AS miou, round(avg(fscore), 6) AS mfscore FROM sc", "px")
def a19b(v):
    return P.mean_scores(_pairs(v)).select(F.round("miou", 6).alias("miou"), F.round("mfscore", 6).alias("mfscore"))


# Neighbourhoods and order

@query("w1_detect_peaks", "SELECT row, col, p FROM px a WHERE p > 0 AND NOT EXISTS (SELECT 1 FROM px b WHERE abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND b.p > a.p)", "px")
def w1(v):
    return S.detect_peaks(v.px()).select("row", "col", "p")


@query("w1_detect_peaks_cross", "SELECT row, col, p FROM px a WHERE p > 0 AND NOT EXISTS (SELECT 1 FROM px b WHERE abs(a.row - b.row) + abs(a.col - b.col) <= 1 AND b.p > a.p)", "px")
def w1b(v):
    return S.detect_peaks(v.px(), connectivity=1).select("row", "col", "p")


@query("w1_peaks_per_scene", """SELECT scene, count(*) AS peaks, round(max(p), 6) AS highest FROM px a WHERE p > 0 AND NOT EXISTS (SELECT 1 FROM px b WHERE abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND b.p > a.p) GROUP BY scene""", "px")
def w1c(v):
    return S.detect_peaks(v.px()).groupBy("scene").agg(F.count(F.lit(1)).alias("peaks"), F.round(F.max("p"), 6).alias("highest"))


_GREEDY = """, o AS (SELECT id, CAST(row_number() OVER (ORDER BY {score} DESC, id) AS INT) AS k FROM {rows}),
adj AS (SELECT oa.k AS k, list(ob.k) AS near FROM {pairs} p JOIN o oa ON oa.id = p.a JOIN o ob ON ob.id = p.b WHERE ob.k < oa.k GROUP BY oa.k),
arr AS MATERIALIZED (SELECT list(coalesce(near, []::INT[]) ORDER BY o.k) AS a FROM o LEFT JOIN adj USING (k)),
g AS (WITH RECURSIVE r(k, kept) AS (SELECT 0, []::INT[] UNION ALL
  SELECT r.k + 1, CASE WHEN list_has_any(a[r.k + 1], kept) THEN kept ELSE list_append(kept, r.k + 1) END FROM r, arr WHERE r.k < len(a))
  SELECT unnest(kept) AS k FROM (SELECT kept FROM r ORDER BY k DESC LIMIT 1))
SELECT id FROM o JOIN g USING (k)"""


@query("w2_j10_deduplicate_crowns", f", pr AS (SELECT a.id AS a, b.id AS b FROM crown a JOIN crown b ON a.id <> b.id AND a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 WHERE {_IOU} / ({_AREA} - {_IOU}) >= 0.3)" + _GREEDY.format(score="score", rows="crown", pairs="pr"), "crown")
def w2(v):
    return SP.deduplicate_boxes(v.crown(), 0.3, 2.0).select("id")


@query("w2_j9_suppress_seeds", _SEEDS + ", x AS (SELECT seed_id AS id, strength FROM sd), pr AS (SELECT a.seed_id AS a, b.seed_id AS b FROM sd a JOIN sd b ON a.seed_id <> b.seed_id AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 9)" + _GREEDY.format(score="strength", rows="x", pairs="pr"), "px")
def w2b(v):
    return SP.suppress_close(_seeds(v).select(F.col("seed_id").alias("id"), F.col("col").alias("x"), F.col("row").alias("y"), "strength"), 3).select("id")


@query("w3_blur", """, h AS (SELECT max(row) AS m FROM px), k AS (SELECT * FROM (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) t(d, w)),
a AS (SELECT px.row, px.col, sum(b.p * w / 16::DOUBLE) AS p FROM px, k, h JOIN px b ON true WHERE b.col = px.col AND b.row = CASE WHEN px.row + d < 0 THEN -(px.row + d) WHEN px.row + d > m THEN 2 * m - px.row - d ELSE px.row + d END GROUP BY ALL)
SELECT a.row, a.col, round(sum(b.p * w / 16::DOUBLE), 6) AS p FROM a, k JOIN a b ON true WHERE b.row = a.row AND b.col = CASE WHEN a.col + d < 0 THEN -(a.col + d) WHEN a.col + d > 49 THEN 98 - a.col - d ELSE a.col + d END GROUP BY a.row, a.col""", "px")
def w3(v):
    return S.blur(v.px(), 5).select("row", "col", F.round("p", 6).alias("p"))


@query("w4_distance_transform", "SELECT a.row, a.col, CASE WHEN a.palm THEN round(sqrt(min((a.row - b.row) ** 2 + (a.col - b.col) ** 2)), 6) ELSE 0 END AS dist FROM px a, px b WHERE NOT b.palm AND b.row BETWEEN a.row - 12 AND a.row + 12 GROUP BY a.row, a.col, a.palm", "px")
def w4(v):
    return S.distance_transform(v.px()).select("row", "col", F.round("dist", 6).alias("dist"))


@query("w5_watershed")
def w5(v):
    seeds = _seeds(v).withColumn("scene", F.lit("s"))
    return I.assign_watershed(v.px(), seeds)


@query("w7_tile_grid", "SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM range(0, 700, 96) a(y), range(0, 500, 96) b(x)")
def w7(v):
    return P.tile_grid(700, 500, 128, 32, v.spark)


_GRID = """, pc AS (SELECT region_id, split, CAST(floor(x0 * 4) AS BIGINT) AS c0, least(190, CAST(ceil(x1 * 4) AS BIGINT)) AS c1, CAST(floor((40 - y1) * 4) AS BIGINT) AS r0, least(150, CAST(ceil((40 - y0) * 4) AS BIGINT)) AS r1 FROM reg),
gr AS (SELECT region_id, lower(trim(split)) AS split, r, c, c0 + c * 12 AS x_off, r0 + r * 12 AS y_off FROM pc, unnest(range(0, CASE WHEN r1 - r0 > 4 THEN CAST(ceil((r1 - r0 - 4) / 12.0) AS BIGINT) ELSE 1 END)) a(r),
  unnest(range(0, CASE WHEN c1 - c0 > 4 THEN CAST(ceil((c1 - c0 - 4) / 12.0) AS BIGINT) ELSE 1 END)) b(c) WHERE c0 + c * 12 < 190 AND r0 + r * 12 < 150)"""


def _grid(v):
    return T.region_grid(VE.split_regions(v.region()), (0.25, 0, 0, 0, -0.25, 40), 190, 150, 16, 4)


@query("w8_b12_region_grid", _GRID + " SELECT region_id, r, c, x_off, y_off FROM gr", "region")
def w8(v):
    return _grid(v).select("region_id", "r", "c", "x_off", "y_off")


@query("w9_number_tiles", _GRID + """ SELECT region_id, r, c, row_number() OVER w - 1 AS tile_id, 'j_' || split || '_tile_' || lpad(CAST(row_number() OVER w - 1 AS VARCHAR), 6, '0') AS tile_name
FROM gr WINDOW w AS (PARTITION BY split ORDER BY region_id, r, c)""", "region")
def w9(v):
    return T.number_tiles(_grid(v).withColumn("job_name", F.lit("j"))).select("region_id", "r", "c", "tile_id", "tile_name")


@query("w10_o2_o3_rank", "SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS BIGINT) AS rank FROM crown", "crown")
def w10(v):
    return P.ranked(v.crown().select("id", "score"), F.desc("score"), "id").select("id", F.col("rank").cast("long").alias("rank"))


@query("o3_restored_order", "SELECT id, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS rank, CAST(row_number() OVER (ORDER BY score DESC, id) AS BIGINT) AS by_score FROM crown", "crown")
def o3(v):
    # The order of ids is noted, the layer is ranked by score, and the noted order is restored.
    noted = P.ranked(v.crown().select("id", "score"), "id").select("id", "score", F.col("rank").alias("noted"))
    best = P.ranked(noted, F.desc("score"), "id").withColumnRenamed("rank", "by_score")
    return best.orderBy("noted").select("id", F.col("noted").cast("long").alias("rank"), F.col("by_score").cast("long").alias("by_score"))


# Order, limits, sets

@query("o1_class_order", "SELECT id, cls FROM crown JOIN classes USING (class_name) ORDER BY cls, id", "crown classes")
def o1(v):
    return v.crown().join(F.broadcast(v.classes()), "class_name").select("id", "cls").orderBy("cls", "id")


@query("o5_first_n", "SELECT split, name FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY name) AS k FROM (SELECT event_type AS split, event_id AS name FROM events)) WHERE k <= 50")
def o5(v):
    return V.first_n(v.table("events").select(F.col("event_type").alias("split"), F.col("event_id").alias("name")))


@query("o8_b6_largest_part", "SELECT class_name, id FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY round((x1 - x0) * (y1 - y0), 6) DESC, id) AS k FROM crown) WHERE k = 1", "crown")
def o8(v):
    parts = v.crown().select("class_name", "id", G.box_ring("x0", "y0", "x1", "y1").alias("ring"))
    return I.largest_part(parts, "class_name", "id").select("class_name", "id")


@query("u1_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u1(v):
    return v.table("documents").select("doc_id").subtract(v.table("labels").select("doc_id"))


@query("u2_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u2(v):
    return v.table("customer").select(F.col("c_nationkey").alias("k")).union(v.table("supplier").select("s_nationkey")).distinct()


@query("u3_concatenate", "SELECT c_name AS name, c_acctbal AS v FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def u3(v):
    return v.table("customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("v")).unionByName(v.table("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("v")))


# Raster to vector, geometry

@query("b1_burn", """, c AS (SELECT *, CAST(id % 5 + 1 AS INT) AS cls FROM crown), g AS (SELECT row, col, col + 0.5::DOUBLE AS x, row + 0.5::DOUBLE AS y FROM px)
SELECT row, col, CASE WHEN col < 45 THEN coalesce(max(cls), 0) ELSE 0 END AS mask FROM g LEFT JOIN c ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY row, col""", "px crown")
def b1(v):
    px = v.px().select("row", "col", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"), (F.col("col") < 45).alias("inside"))
    polygons = v.crown().select((F.col("id") % 5 + 1).cast("int").alias("cls"), G.box_ring("x0", "y0", "x1", "y1").alias("ring"), "x0", "y0", "x1", "y1")
    return T.burn(px, polygons, 2.0, "inside").select("row", "col", "mask")


@query("b2_b3_affine", "SELECT id, 0.31::DOUBLE * x0 + 0.0::DOUBLE * y0 + 400000.0::DOUBLE AS x, 0.0::DOUBLE * x0 + -0.31::DOUBLE * y0 + 2700000.0::DOUBLE AS y FROM crown", "crown")
def b3(v):
    x, y = G.apply_affine("x0", "y0", GEO)
    return v.crown().select("id", x.alias("x"), y.alias("y"))


@query("b4_circle", "SELECT id, 65 AS points, round(64 / 2.0::DOUBLE * sin(2 * pi() / 64) * greatest(p, 1.0) / pi(), 6) AS area FROM (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) - 10 AS p FROM part)")
def b4(v):
    c = v.table("part").select(F.col("p_partkey").alias("id"), G.circle_ring(F.lit(3.0), F.lit(-2.0), F.col("p_size").cast("double") - 10).alias("ring"))
    return c.select("id", F.size("ring").alias("points"), F.round(G.ring_area("ring"), 6).alias("area"))


@query("b8_crowns")
def b8(v):
    tree = I.trees(_instances(v), "p", 4)
    return I.crowns(tree, GEO).drop("ring")


@query("b5_b7_polygons")
def b7(v):
    tree = I.trees(_instances(v), "p", 4)
    return I.crowns(tree, GEO, "polygon", simplify_px=0.5).withColumn("corners", F.size("ring")).drop("ring")


@query("b9_diameter", _INST + " SELECT inst, round(2 * sqrt(count(*) * (0.31::DOUBLE * 0.31::DOUBLE) / pi()), 6) AS diam_m FROM i GROUP BY inst", "px")
def b9(v):
    return I.instance_stats(_instances(v)).select("inst", F.round(G.crown_diameter("n_px", G.pixel_size(GEO)), 6).alias("diam_m"))


@query("b11_tile_boxes", _GRID + " SELECT region_id, r, c, 0.25::DOUBLE * x_off AS x0, 40 - 0.25::DOUBLE * (y_off + 16) AS y0, 0.25::DOUBLE * (x_off + 16) AS x1, 40 - 0.25::DOUBLE * y_off AS y1 FROM gr", "region")
def b11(v):
    return T.tile_boxes(_grid(v), (0.25, 0, 0, 0, -0.25, 40), 16).select("region_id", "r", "c", "x0", "y0", "x1", "y1")


# Scalars

@query("n1_stretch", _STRETCH + " SELECT row, col, band, CASE WHEN value = 0 THEN 0 ELSE CAST(floor(least(255, greatest(0, (value - lo) / (hi - lo) * 255))) AS INT) END AS value FROM ms JOIN st USING (band)", "ms")
def n1(v):
    j = v.ms().join(F.broadcast(P.percentile_stretch(v.ms())), "band")  # one row per band
    return j.select("row", "col", "band", R.stretch(F.col("value"), F.col("lo"), F.col("hi")).alias("value"))


@query("n2_softmax", ", e AS (SELECT row, col, band, exp(value - max(value) OVER (PARTITION BY row, col)) AS e FROM ms) SELECT row, col, band, round(e / sum(e) OVER (PARTITION BY row, col), 6) AS p FROM e", "ms")
def n2(v):
    vec = v.ms().groupBy("row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "value"))), lambda s: s["value"]).alias("z"))
    return vec.select("row", "col", F.posexplode(R.softmax(F.col("z"))).alias("band", "p")).withColumn("p", F.round("p", 6))


# Validation and orchestration

@query("v3_memory", "SELECT o_orderkey AS h, round(o_orderkey * 2000 * 13 / 1e9::DOUBLE, 6) AS gb FROM orders")
def v3(v):
    return v.table("orders").select(F.col("o_orderkey").alias("h"), F.round(P.memory_gb(F.col("o_orderkey"), F.lit(2000), 2), 6).alias("gb"))


@query("v4_preflight", """WITH j AS (SELECT p_name || CASE WHEN p_size < 25 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS name, p_size AS tile, p_partkey % 30 - 1 AS overlap, p_partkey % 4 AS n_sources,
  CASE p_partkey % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' END AS split, CASE WHEN p_partkey % 5 >= 3 THEN 'f' END AS split_file, CASE WHEN p_partkey % 2 = 0 THEN 'k' END AS split_field, p_partkey FROM part)
SELECT 'no sources' AS rule, name AS subject FROM j WHERE n_sources = 0 UNION ALL SELECT 'overlap not below tile size', name FROM j WHERE overlap >= tile UNION ALL SELECT 'negative overlap', name FROM j WHERE overlap < 0
UNION ALL SELECT 'neither split nor split file', name FROM j WHERE split IS NULL AND split_file IS NULL UNION ALL SELECT 'unknown split', name FROM j WHERE split = 'dev'
UNION ALL SELECT 'split file without field', name FROM j WHERE split_file IS NOT NULL AND split_field IS NULL
UNION ALL SELECT 'repeated job name', name FROM (SELECT name, row_number() OVER (PARTITION BY name ORDER BY tile) AS k FROM j) WHERE k > 1
UNION ALL SELECT 'class value below 1', 'zero' UNION ALL SELECT 'repeated class value', 'second'""")
def v4(v):
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(F.col("p_size") < 25, "").otherwise(k.cast("string")))
    jobs = v.table("part").select(name.alias("name"), F.col("p_size").alias("tile"), (k % 30 - 1).alias("overlap"), (k % 4).alias("n_sources"), F.when(k % 5 == 0, "train").when(k % 5 == 1, "dev").alias("split"), F.when(k % 5 >= 3, "f").alias("split_file"), F.when(k % 2 == 0, "k").alias("split_field"))
    classes = v.spark.createDataFrame([("first", 1), ("second", 1), ("zero", 0)], "class_name string, cls int")
    return V.preflight(jobs, classes)


@query("v5_check_dataset", """WITH i AS (SELECT doc_id AS stem FROM documents), m AS (SELECT doc_id AS stem FROM labels),
u AS (SELECT 'all/' || stem AS stem FROM i WHERE stem NOT IN (SELECT stem FROM m)), k AS (SELECT stem, row_number() OVER (ORDER BY stem) AS k FROM u)
SELECT 'image without mask' AS "check", string_agg(stem, ', ' ORDER BY stem) FILTER (WHERE k <= 3) AS detail, count(*) AS n FROM k
UNION ALL SELECT 'band count', CAST(n_chars % 4 AS VARCHAR), count(*) FROM documents WHERE n_chars % 4 <> 3 GROUP BY n_chars % 4
UNION ALL SELECT 'mask value', CAST(quality * 7 AS VARCHAR), count(*) FROM labels WHERE quality * 7 > 1 GROUP BY quality""")
def v5(v):
    images = v.table("documents").select(F.lit("all").alias("split"), F.col("doc_id").alias("stem"))
    masks = v.table("labels").select(F.lit("all").alias("split"), F.col("doc_id").alias("stem"), (F.col("quality") * 7).alias("value"))
    bands = v.table("documents").select(F.col("doc_id").alias("stem"), (F.col("n_chars") % 4).alias("n_bands"))
    return V.check_dataset(images, masks, bands, 2, 3)


@query("v7_batch", """, f AS (SELECT row // 10 AS k, count(*) FILTER (WHERE palm) AS n, max(p) AS top FROM px GROUP BY ALL)
SELECT CAST(k AS VARCHAR) AS file, CASE WHEN top > 0.999 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN top > 0.999 THEN NULL ELSE n END AS tree_count, CASE WHEN top > 0.999 THEN 'ValueError: too bright' END AS error FROM f""", "px")
def v7(v):
    def work(part):
        if part["p"].max() > 0.999:
            raise ValueError("too bright")
        return part["palm"].sum()

    return BA.run_batch(v.px().select(F.floor(F.col("row") / 10).cast("string").alias("file"), "p", "palm"), work)


@query("v7_resume", "SELECT DISTINCT doc_id AS stem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def v7b(v):
    return BA.pending(v.table("documents").select(F.col("doc_id").alias("stem")), v.table("labels").select(F.col("doc_id").alias("stem")))[0]


@query("v8_v9_extract")
def v9(v):
    px = v.px().withColumn("p", F.col("p").cast("double"))
    return extract(px, GEO, 1, method="voronoi", min_area=4, min_seed_distance=2, dedup_iou=0.3).drop("ring")


@query("v8_j10_scene_dedup", """WITH c AS (SELECT p_partkey AS id, p_partkey % 50 AS scene, p_partkey // 50 // 2 AS pair, p_retailprice AS score FROM part)
SELECT id, scene FROM (SELECT *, row_number() OVER (PARTITION BY scene, pair ORDER BY score DESC, id) AS k FROM c) WHERE k = 1 OR pair % 2 = 1""")
def v8_dedup(v):
    # Pairs of discs of radius 2: those 1 apart overlap by 0.52, those 2 apart by 0.24 (their boxes by 0.33).
    k = F.floor(F.col("p_partkey") / 50)
    pair = F.floor(k / 2)
    x = (pair * 100 + (k % 2) * F.when(pair % 2 == 1, 2).otherwise(1)).cast("double")
    c = v.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("scene"), x.alias("x"), F.col("p_retailprice").alias("score"))
    bounds = {"x0": F.col("x") - 2, "x1": F.col("x") + 2, "y0": F.lit(-2.0), "y1": F.lit(2.0), "ring": G.circle_ring("x", F.lit(0.0), F.lit(4 * math.pi))}
    return SP.deduplicate_rings(c.withColumns(bounds), 0.3, 4.0, by=("scene",)).select("id", "scene")


@query("v10_tile_job", """, size AS (SELECT max(row) + 1 AS h FROM ms),
rg AS (SELECT region_id, lower(trim(split)) AS split, x0, y0, least(x1, 20) AS x1, least(y1, h) AS y1, CASE WHEN lower(trim(split)) = 'train' THEN 2 ELSE 0 END AS o FROM reg, size WHERE x0 < 20 AND y0 < h),
spot AS (SELECT region_id, split, r, c, x0, y0, x1, y1, CAST(x0 AS BIGINT) + c * (6 - o) AS x, CAST(y0 AS BIGINT) + r * (6 - o) AS y FROM rg,
  unnest(range(0, greatest(1, CAST(ceil((y1 - y0 - o) / (6 - o)) AS BIGINT)))) a(r), unnest(range(0, greatest(1, CAST(ceil((x1 - x0 - o) / (6 - o)) AS BIGINT)))) b(c)),
own AS (SELECT * FROM spot t WHERE x >= x0 AND y >= y0 AND x + 6 <= x1 AND y + 6 <= y1 AND NOT EXISTS (SELECT 1 FROM rg q WHERE q.region_id <> t.region_id
  AND greatest(0, least(t.x + 6, q.x1) - greatest(t.x, q.x0)) * greatest(0, least(t.y + 6, q.y1) - greatest(t.y, q.y0)) > 0.000036)),
mask AS (SELECT row, col, max(id % 5 + 1) AS cls FROM (SELECT DISTINCT row, col FROM ms) p JOIN crown ON col + 0.5::DOUBLE >= x0 AND col + 0.5::DOUBLE < x1 AND row + 0.5::DOUBLE >= y0 AND row + 0.5::DOUBLE < y1 GROUP BY row, col),
tiles AS (SELECT region_id, split, r, c, sum(value) AS value_sum, sum(CASE WHEN band = 0 THEN coalesce(cls, 0) ELSE 0 END) AS mask_sum FROM own JOIN ms ON row >= y AND row < y + 6 AND col >= x AND col < x + 6 LEFT JOIN mask USING (row, col)
  GROUP BY region_id, split, r, c HAVING count_if(value <> 0) / (36.0 * 8) >= 0.5 AND max(coalesce(cls, 0)) > 0)
SELECT region_id, r, c, 'j_' || split || '_tile_' || lpad(CAST(row_number() OVER w - 1 AS VARCHAR), 6, '0') AS tile_name, value_sum, CAST(mask_sum AS BIGINT) AS mask_sum FROM tiles WINDOW w AS (PARTITION BY split ORDER BY region_id, r, c)""", "ms crown region")
def v10(v):
    px = v.ms()
    job = TileJob("j", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), 20, px.agg(F.max("row") + 1).first()[0], tile=6, overlap=2, boundary="strict", stretch=False)
    polygons = v.crown().select((F.col("id") % 5 + 1).cast("int").alias("cls"), G.box_ring("x0", "y0", "x1", "y1").alias("ring"), "x0", "y0", "x1", "y1")
    made = tile_job(job, px, v.region(), polygons)
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    sums = made["pixels"].groupBy("tile_name").agg(F.sum(total).alias("value_sum"), F.sum("mask").alias("mask_sum"))
    return made["index"].select("region_id", "r", "c", "tile_name").join(sums, "tile_name")
