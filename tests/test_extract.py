"""Whole plans and kernels on hand-built rasters."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgrid.functions import geometry as G
from loomgrid.operators import batch as BA
from loomgrid.operators import instances as I
from loomgrid.operators import pixels as P
from loomgrid.operators import seeds as S
from loomgrid.operators import spatial as SP
from loomgrid.operators import validate as V
from loomgrid.plans.batches import batch_extract
from loomgrid.plans.extract import extract, extract_trees, segment
from loomgrid.sources import rasters as RA
from loomgrid.sources import vectors as VE

GEO = (0.31, 0.0, 400000.0, 0.0, -0.31, 2700000.0)


def cones(size, places):
    y, x = np.mgrid[:size, :size]
    return np.max([np.clip(1 - np.sqrt((y - r) ** 2 + (x - c) ** 2) / k, 0, 1) for r, c, k in places], axis=0)


def table(spark, p, mask):
    r, c = np.indices(p.shape)
    return spark.createDataFrame(pd.DataFrame({"scene": "s", "row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "p": p.ravel(), "palm": mask.ravel(), "cls": mask.ravel().astype("int32")}))


@pytest.fixture(scope="module")
def scene(spark):
    p = cones(90, [(25, 25, 14), (25, 46, 14), (65, 60, 16)])
    return table(spark, p, p > 0.15).cache()


@pytest.mark.parametrize("method", ["watershed", "voronoi"])
def test_touching_crowns_are_split(scene, method):
    pixels, trees = extract_trees(scene, method)
    assert trees.count() == 3
    assert pixels.filter("inst > 0").count() == scene.filter("palm").count()


def test_seeds_lie_on_the_tops(scene):
    got = {(r.row, r.col) for r in S.find_seeds(scene).collect()}
    assert got == {(25, 25), (25, 46), (65, 60)}
    assert S.find_seeds(scene, has_heatmap=False).count() >= 3
    assert S.find_seeds(scene, min_distance=30).count() == 2


def test_crowns_are_georeferenced(scene):
    rows = extract(scene, GEO, method="voronoi").collect()
    assert len(rows) == 3
    for r in rows:
        assert r.diam_m == pytest.approx(2 * np.sqrt(r.area_px * 0.31**2 / np.pi), abs=2e-2)
        assert len(r.ring) == 65
    assert extract(scene, GEO, geometry="polygon", dedup_iou=0.01, method="voronoi").count() <= 3


def test_solid_blob_and_empty_mask(spark):
    m = np.zeros((40, 40), bool)
    assert extract_trees(table(spark, m * 1.0, m), has_heatmap=False)[1].count() == 0
    m[10:30, 10:30] = True
    tree = extract_trees(table(spark, m * 1.0, m), has_heatmap=False)[1].collect()
    assert len(tree) == 1 and tree[0].area_px == 361 and tree[0].n_px == 400


def test_true_overlap_decides(spark):
    """Three discs: the middle score overlaps the best by more than half and goes; the far one stays."""
    rows = [(1, 0.0, 0.9), (2, 0.5, 0.5), (3, 100.0, 0.8)]
    c = spark.createDataFrame(rows, "id int, x double, score double").withColumn("ring", G.circle_ring("x", F.lit(0.0), F.lit(25 * np.pi)))
    c = c.withColumns({"x0": F.col("x") - 5, "x1": F.col("x") + 5, "y0": F.lit(-5.0), "y1": F.lit(5.0)})
    both = c.withColumn("scene", F.lit("a")).unionAll(c.withColumns({"scene": F.lit("b"), "score": -F.col("score")}))
    got = {(r.scene, r.id) for r in SP.deduplicate_rings(both, 0.5, 10.0, by=("scene",)).collect()}
    assert got == {("a", 1), ("a", 3), ("b", 2), ("b", 3)}
    disc = lambda x: np.array([(x + np.cos(2 * np.pi * (k % 64) / 64), np.sin(2 * np.pi * (k % 64) / 64)) for k in range(65)])
    lens = G.shared_area(disc(0.0), disc(1.0))
    assert lens == pytest.approx(2 * np.pi / 3 - np.sqrt(3) / 2, rel=5e-3)
    notched = np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)], float)
    square = np.array([(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)], float)
    assert G.shared_area(notched, square) == pytest.approx(2 * (1 / 2 * 1 * 1.5)) and G.shared_area(square, square + 5) == 0
    assert G.shared_area(square, square) == pytest.approx(4)


def test_nearest_keeps_scenes_and_repeated_points_apart(spark):
    points = spark.createDataFrame([("a", 0, 0), ("a", 0, 0), ("a", 0, 90), ("b", 0, 0), ("c", 1, 1), ("a", None, 3)], "scene string, row int, col int")
    seeds = spark.createDataFrame([("a", 1, 0, 3), ("a", 2, 0, 70), ("b", 1, 50, 50)], "scene string, seed_id int, row int, col int")
    got = sorted((r.scene, str(r.row), r.col, str(r.inst)) for r in SP.nearest(points, seeds, 4, by=("scene",)).collect())
    assert got == [("a", "0", 0, "1"), ("a", "0", 0, "1"), ("a", "0", 90, "2"), ("a", "None", 3, "None"), ("b", "0", 0, "1"), ("c", "1", 1, "None")]


def test_batch_extract(spark):
    """Three scenes of two trees and a broken one: six trees, one failure; then all but the broken one are skipped."""
    p = cones(120, [(40, 40, 15), (80, 80, 18)])
    one = table(spark, p, p > 0.2)
    px = one.limit(0)
    for name in ("scene0", "scene1", "scene2"):
        px = px.unionAll(one.withColumn("scene", F.lit(name)))
    px = px.unionAll(one.withColumn("scene", F.lit("broken")).filter("row <> 7")).cache()
    layer, summary = batch_extract(px, GEO, method="voronoi")
    rows = {r.file: (r.status, r.tree_count) for r in summary.collect()}
    assert rows == {"scene0": ("ok", 2), "scene1": ("ok", 2), "scene2": ("ok", 2), "broken": ("failed", None)}
    assert layer.count() == 6 and BA.totals(summary).first().asDict() == {"processed": 3, "skipped": 0, "failed": 1, "trees": 6}
    layer, again = batch_extract(px, GEO, layer.select("scene").distinct(), method="voronoi")
    assert sorted(r.status for r in again.collect()) == ["failed", "skipped", "skipped", "skipped"] and layer.count() == 0


def test_small_parts(spark, tmp_path):
    grid = RA.grid(spark, 0, 0, 4, 5)
    V.require_same_shape(grid, grid)
    with pytest.raises(ValueError):
        V.require_same_shape(grid, RA.grid(spark, 0, 0, 4, 4))
    px = grid.withColumns({"scene": F.lit("s"), "value": F.col("row") * 5 + F.col("col")})
    VE.write_pixels(px, str(tmp_path / "px"))
    assert spark.read.parquet(str(tmp_path / "px")).count() == 20


def test_kernels():
    m = np.random.default_rng(1).random((25, 31)) > 0.3
    r, c = np.nonzero(~m)
    y, x = np.indices(m.shape)
    want = ((y[..., None] - r) ** 2 + (x[..., None] - c) ** 2).min(-1)
    assert (S.squared_distance(m) == want).all()
    markers = np.zeros(m.shape, int)
    markers[tuple(np.argwhere(m)[0])] = 1
    out = I.flood(m, np.zeros(m.shape), markers)
    assert set(np.unique(out)) <= {0, 1} and not out[~m].any()
    ring = I.trace(np.ones((5, 7), bool))
    assert I.contour_metrics(ring) == (24.0, 20.0)
    hole = np.ones((5, 5), bool)
    hole[2, 2] = False
    rings = I.edge_rings(hole)
    assert len(rings) == 2 and len(rings[0]) == 5
    line = np.array([[0, 0], [1, 0.1], [2, 0], [2, 2], [0, 2]], float)
    assert len(I.simplify_ring(line, 0.5)) == 4


def filled(rings):
    """Pixels (row, col) within an odd number of rings along pixel edges."""
    out = set()
    for ring in rings:
        assert ring[0] == ring[-1]
        for (x, y), (x2, y2) in zip(ring, ring[1:], strict=False):
            assert (x == x2) != (y == y2)
            if x == x2:
                out ^= {(r, c) for r in range(int(min(y, y2)), int(max(y, y2))) for c in range(int(x), 40)}
    return out


def test_mask_polygons_trace_many_components_at_once(spark):
    rng = np.random.default_rng(11)
    masks = {f"s{k}": rng.random((26, 31)) < p for k, p in enumerate((0.35, 0.6, 0.7, 0.8))}
    px = [(s, int(r), int(c), 1) for s, m in masks.items() for r, c in zip(*np.nonzero(m), strict=True)]
    rows = spark.createDataFrame(px + px[:3], "scene string, row int, col int, cls int")  # three pixels come twice
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(records)
    spark.conf.set(records, 7)  # components go on from batch to batch
    try:
        out = I.mask_polygons(rows)
        got = out.collect()
    finally:
        spark.conf.set(records, before)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan  # no Python call for each component
    parts = {}
    for r in got:
        outer, holes = [tuple(q) for q in r.ring], [[tuple(q) for q in h] for h in r.holes]
        pixels = filled([outer, *holes])
        assert pixels <= filled([outer]) and len(pixels) == r.area and min(pixels) == divmod(r.comp, 1 << 31)
        m = np.zeros((28, 33), bool)
        m[tuple(np.array(sorted(pixels)).T + 1)] = True
        assert len(holes) == len(I.parts_of(~m)) - 1  # what isn't set meets at corners, too
        parts.setdefault(r.scene, []).append(pixels)
    assert max(len(q) for q in parts["s3"]) > 500 and any(len(r.holes) > 20 for r in got)
    for s, m in masks.items():
        owner = {q: k for k, pixels in enumerate(parts[s]) for q in pixels}
        assert len(owner) == sum(map(len, parts[s])) and set(owner) == set(zip(*(v.tolist() for v in np.nonzero(m)), strict=True))
        assert all(owner.get((r + i, c + j), k) == k for (r, c), k in owner.items() for i, j in ((0, 1), (1, 0)))
    assert I.edge_rings(np.zeros((3, 3), bool)) == []
    simple = {(r.scene, r.comp): r for r in I.mask_polygons(rows, 1, (2, 0, 10, 0, -2, 5), 0.1).collect()}
    assert len(simple) == len(got)
    for r in got:
        at = simple[r.scene, r.comp]
        assert [(q.x, q.y) for q in at.ring] == [(2 * q.x + 10, 5 - 2 * q.y) for q in r.ring] and len(at.holes) == len(r.holes)


def test_segment_equals_the_score_and_skips_nodata(spark):
    px = RA.grid(spark, 0, 0, 40, 40).withColumn("value", F.when((F.col("row") < 8) & (F.col("col") < 8), 0.0).otherwise(1.0)).withColumn("valid", F.col("value") > 0)

    def scorer(t):
        p = F.when(((F.col("row") + F.col("col")) % 2) == 0, 0.9).otherwise(0.1)
        return t.withColumn("cls", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("p", F.when(F.col("cls") == 1, p).otherwise(1 - p))

    out = segment(px, scorer, 16, 8).toPandas()
    dark = (out["row"] < 8) & (out["col"] < 8)
    assert not out.loc[dark, "cls"].any()
    assert (out.loc[~dark, "cls"] == ((out["row"] + out["col"]) % 2 == 0)[~dark].astype(int)).all()
    with pytest.raises(ValueError):
        P.tile_grid(10, 10, 4, 4, spark)
    with pytest.raises(MemoryError):
        P.check_memory(200_000, 200_000, 2, 8)


def test_sources_and_sinks(spark, tmp_path):
    nan = spark.createDataFrame([(0, 0, 0, float("nan")), (0, 1, 0, 0.5)], "row int, col int, band int, value double")
    got = {(r.row, r.col): (r.value, r.valid) for r in RA.read_window(nan, 0, 0, 2, float("nan")).collect()}
    assert got[0, 0] == (0.0, False) and got[0, 1] == (0.5, True)
    layer = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)])], "id int, ring array<struct<x:double,y:double>>")
    VE.write_layer(layer, str(tmp_path / "a.geojson"), "ring", ["id"])
    assert VE.read_geojson(spark, str(tmp_path / "a.geojson"), "id int").collect() == layer.collect()
    batch = spark.createDataFrame([("x/b.tif", "failed", None, "bad"), ("x/a.tif", "ok", 3, None)], "file string, status string, tree_count long, error string")
    VE.write_summary(batch.coalesce(1), str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).columns == ["file", "status", "tree_count", "error"]
    assert RA.listing(spark, str(tmp_path / "s"), "*.csv").count() >= 1
    bad = spark.createDataFrame([("train",), ("dev",)], "split string")
    with pytest.raises(ValueError):
        VE.require_splits(bad)
    with pytest.raises(KeyError):
        VE.split_regions(bad, "other")
    with pytest.raises(ValueError):
        V.require_grid(nan.limit(1).unionAll(nan.limit(1)))
