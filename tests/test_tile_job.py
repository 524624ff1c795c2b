"""The tiling job against a brute-force version on rectilinear polygons, whose areas are pixel counts."""

import json
import math

import numpy as np
import pytest

from loomgrid.functions import geometry as G
from loomgrid.plans import tile_job as J

H, W, TRANSFORM = 41, 50, (0.5, 0.0, 100.0, 0.0, -0.5, 300.0)
#: region, split, ring in pixels (x, y); the L reaches beyond the mosaic, the last two overlap, region 5 lies outside.
REGIONS = [
    (1, "train", [(-6, -4), (22, -4), (22, 14), (12, 14), (12, 30), (-6, 30)]),
    (2, " Val ", [(24, 0), (50, 0), (50, 20), (24, 20)]),
    (3, "test", [(0, 31), (40, 31), (40, 41), (0, 41)]),
    (4, "val", [(30, 33), (50, 33), (50, 41), (30, 41)]),
    (5, "test", [(60, 0), (70, 0), (70, 9), (60, 9)]),
]
NOTES = [(1, [(2, 2), (9, 2), (9, 6), (2, 6)]), (3, [(5, 4), (20, 4), (20, 8), (5, 8)]), (2, [(6, 5), (30, 5), (30, 12), (6, 12)]), (1, [(1, 33), (4, 33), (4, 36), (1, 36)])]


def ring(points):
    a, _, c, _, e, f = TRANSFORM
    return [(a * x + c, e * y + f) for x, y in [*points, points[0]]]


def inside(points):
    y, x = np.mgrid[:H, :W] + 0.5
    out = np.zeros((H, W), bool)
    for (x0, y0), (x1, y1) in zip(points, [*points[1:], points[0]], strict=True):
        if y0 != y1:
            out ^= ((y0 > y) != (y1 > y)) & (x < x0)
    return out


@pytest.fixture(scope="module")
def mosaic():
    rng = np.random.default_rng(3)
    px = rng.integers(1, 1000, (3, H, W))
    px[:, :9, 30:44] = 0
    px[:, 33:, :14] = 0
    px[1, rng.random((H, W)) < 0.3] = 0
    return px


@pytest.fixture(scope="module")
def layers(spark, mosaic):
    cells = [(int(y), int(x), b, float(v)) for (b, y, x), v in np.ndenumerate(mosaic)]
    px = spark.createDataFrame(cells, "row int, col int, band int, value double").cache()
    regions = spark.createDataFrame([(k, s, ring(p)) for k, s, p in REGIONS], "region_id int, split string, ring array<struct<x:double,y:double>>")
    notes = spark.createDataFrame([(c, ring(p)) for c, p in NOTES], "cls int, ring array<struct<x:double,y:double>>")
    return px, regions, notes.withColumns(G.ring_bounds("ring"))


def brute(job, px, start):
    bands = [b - 1 for b in job.bands or range(1, len(px) + 1)]
    masks = {k: inside(p) for k, _, p in REGIONS}
    classes = np.zeros((H, W), int)
    for c, p in sorted(NOTES, key=lambda n: n[0]):
        classes[inside(p)] = c
    tiles, pixels, dropped, number = [], {}, {}, dict(start)
    for k, split, p in REGIONS:
        split, here = split.strip().lower(), masks[k]
        if not here.any():
            continue
        xs, ys = zip(*p, strict=True)
        x0, y0, x1, y1 = max(0, min(xs)), max(0, min(ys)), min(W, max(xs)), min(H, max(ys))
        lap = job.overlap if split == "train" else 0
        count = lambda n, lap=lap: math.ceil((n - lap) / (job.tile - lap)) if n > lap else 1
        for r in range(count(y1 - y0)):
            for c in range(count(x1 - x0)):
                y, x = y0 + r * (job.tile - lap), x0 + c * (job.tile - lap)
                if y >= H or x >= W:
                    continue
                cut = (slice(y, y + job.tile), slice(x, x + job.tile))
                own = here[cut].sum()
                others = max(m[cut].sum() for j, m in masks.items() if j != k)
                tile = np.zeros((len(bands), job.tile, job.tile))
                mask = np.zeros((job.tile, job.tile), int)
                part = px[bands][:, *cut]
                tile[:, : part.shape[1], : part.shape[2]] = part
                has = bool(part.any())
                mask[: part.shape[1], : part.shape[2]] = classes[cut]
                if job.boundary == "strict" and own < job.tile**2:
                    why = "partial_edge"
                elif own == 0:
                    continue
                elif others:
                    why = "straddling"
                else:
                    if job.boundary == "mask":
                        shown = np.zeros((job.tile, job.tile), bool)
                        shown[: part.shape[1], : part.shape[2]] = here[cut]
                        tile, mask = tile * shown, mask * shown
                    why = "nodata" if not has or (tile != 0).mean() < job.min_coverage else None if mask.any() or job.keep_background else "background_only"
                if why:
                    dropped[why] = dropped.get(why, 0) + 1
                    continue
                name = f"{job.name}_{split}_tile_{number.get(split, 0):06d}"
                number[split] = number.get(split, 0) + 1
                tiles.append((split, name, bool(mask.any()), k, r, c))
                pixels[name] = tile, mask
    return tiles, pixels, dropped


CASES = [
    dict(boundary="strict", tile=6, overlap=2, min_coverage=0.5, keep_background=True),
    dict(boundary="strict", tile=6, overlap=2, min_coverage=0.9, keep_background=False, bands=(3, 1)),
    dict(boundary="mask", tile=8, overlap=3, min_coverage=0.3, keep_background=True),
    dict(boundary="mask", tile=8, overlap=0, min_coverage=0.0, keep_background=False),
]


@pytest.mark.parametrize("case", CASES)
def test_tiles_equal_brute_force(spark, mosaic, layers, case):
    px, regions, notes = layers
    job = J.TileJob("j", TRANSFORM, W, H, stretch=False, **case)
    old = spark.createDataFrame([("train", "j_train_tile_000006"), ("train", "j_train_tile_000002"), ("train", "k_train_tile_000090")], "split string, name string")
    made = J.tile_job(job, px, regions, notes, old)
    tiles, pixels, dropped = brute(job, mosaic, {"train": 7})
    assert tiles and dropped
    got = made["index"].select("split", "tile_name", "has_foreground", "region_id", "r", "c").collect()
    assert sorted(map(tuple, got)) == sorted(tiles)
    assert {r.reason: r.n for r in made["dropped"].collect()} == dropped
    n = 0
    for r in made["pixels"].collect():
        tile, mask = pixels[r.tile_name]
        assert r["values"] == tile[:, r.row, r.col].tolist() and r["mask"] == mask[r.row, r.col]
        n += 1
    assert n == len(tiles) * job.tile**2


def test_written_tiles_log_and_stretch(spark, mosaic, layers, tmp_path):
    px, regions, notes = layers
    classes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "cls int, class_name string")
    job = J.TileJob("j", TRANSFORM, W, H, tile=8, overlap=3, min_coverage=0.3, keep_background=True)
    made = J.tile_job(job, px, regions, notes)
    log = json.loads(J.write_tiles(job, made, classes, str(tmp_path), debug=True).first()[0])
    _, pixels, dropped = brute(job, mosaic, {})
    assert {d["reason"]: d["n"] for d in log["dropped"]} == dropped and log["config"]["tile"] == 8
    top = [np.percentile(b[b > 0], [2, 98]) for b in mosaic]
    for r in J.scan_tiles(spark, str(tmp_path), "images").collect():
        raw = pixels[r.tile_name][0][:, r.row, r.col]
        want = [0 if v == 0 else int(min(255, max(0, (v - lo) / (hi - lo) * 255))) for v, (lo, hi) in zip(raw, top, strict=True)]
        assert np.abs(np.array(r["values"]) - want).max() <= 1e-9
    counts = {}
    for name, (_, mask) in pixels.items():
        for cls, n in zip(*np.unique(mask, return_counts=True), strict=True):
            key = name.split("_")[1], int(cls)
            counts[key] = counts.get(key, 0) + int(n)
    found = {(b["split"], b["cls"]): b["px"] for b in log["class_pixel_balance"] if b["px"]}
    assert found == counts and J.scan_tiles(spark, str(tmp_path), "masks").count() == sum(counts.values())
    assert {p["problem"] for p in log["problems"]} <= {"overlap"} and sum(t["tiles"] for t in log["tiles"]) == len(pixels)
    palette = json.loads(spark.read.text(f"{tmp_path}/class_palette").first()[0])
    assert palette["0"] == "background" and len(palette) == 5
    assert spark.read.text(f"{tmp_path}/debug_boundary_j.geojson").count() == 4


def test_an_empty_mosaic_and_wrong_settings(spark, layers):
    px, regions, notes = layers
    made = J.tile_job(J.TileJob("j", TRANSFORM, W, H, tile=8, overlap=2, keep_background=True), px.limit(0), regions, notes)
    assert made["index"].count() == 0 and made["pixels"].count() == 0
    with pytest.raises(ValueError):
        J.TileJob("j", TRANSFORM, W, H, boundary="loose")
    with pytest.raises(ValueError):
        J.TileJob("j", TRANSFORM, W, H, tile=8, overlap=8)


def test_clipped_polygons():
    rng = np.random.default_rng(5)
    for _ in range(200):
        angle, far = np.sort(rng.random(9)) * 2 * np.pi, 0.5 + 6 * rng.random(9)
        p = np.stack([4 + far * np.cos(angle), 5 + far * np.sin(angle)], 1)  # simple, seldom convex
        p = np.vstack([p, p[:1]])
        box = np.array([(2.0, 3.0), (7.0, 3.0), (7.0, 8.0), (2.0, 8.0), (2.0, 3.0)])
        cut = G.clip_ring(p, 2, 3, 7, 8)
        area = G.shared_area(p, box)
        assert math.isclose(G.shared_area(cut, box) if len(cut) else 0.0, area, abs_tol=1e-9)
    assert len(G.clip_ring(box, 20, 20, 30, 30)) == 0
