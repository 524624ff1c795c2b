"""From seeds to instances: assignment, metrics, contours, polygons."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.geometry import circle_ring, circularity, crown_diameter, pixel_size, ring_area, transform_ring
from loomgrid.operators.seeds import squared_distance, to_array
from loomgrid.operators.spatial import nearest

INSTANCE = "scene string, row int, col int, inst int"


def assign_voronoi(mask: DataFrame, seeds: DataFrame, cell: float = 16, by: tuple = ()) -> DataFrame:
    """Every mask pixel (row, col) goes to its nearest seed (seed_id, row, col) of the same ``by``, exactly; see spatial.nearest."""
    return nearest(mask, seeds, cell, by)


def flood(mask: np.ndarray, relief: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Seeded watershed: pixels in order of relief, then of discovery, take the label they are reached from (4 neighbours)."""
    label = np.where(mask, markers, 0)
    heap = [(relief[r, c], k, r, c) for k, (r, c) in enumerate(zip(*np.nonzero(label), strict=True))]
    heapq.heapify(heap)
    age = len(heap)
    h, w = mask.shape
    while heap:
        _, _, r, c = heapq.heappop(heap)
        for y, x in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
            if 0 <= y < h and 0 <= x < w and mask[y, x] and not label[y, x]:
                label[y, x] = label[r, c]
                heapq.heappush(heap, (relief[y, x], age, y, x))
                age += 1
    return label


def assign_watershed(px: DataFrame, seeds: DataFrame, group: str = "scene", has_heatmap: bool = True) -> DataFrame:
    """Flood -p (or, without a heatmap, minus the distance to the background) from the seeds within the mask.

    px: scene, row, col, palm, p and ``group``. Flooding is sequential, so a group is one task: the scene, or a mask component where
    scenes are large (components don't touch). Pixels that no seed reaches get 0. Returns scene, row, col, inst of mask pixels.
    """
    marked = px.join(seeds.select("scene", "row", "col", "seed_id"), ["scene", "row", "col"], "left").withColumn("seed_id", F.coalesce("seed_id", F.lit(0)))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        mask, r0, c0 = to_array(part, "palm", False)
        mask = mask.astype(bool)
        markers = to_array(part.assign(seed_id=part["seed_id"].astype("int64")), "seed_id")[0]
        relief = -to_array(part, "p", 0.0)[0] if has_heatmap else -np.sqrt(squared_distance(mask))
        label = flood(mask, relief, markers)
        part = part[part["palm"].astype(bool)]
        return pd.DataFrame({"scene": part["scene"], "row": part["row"], "col": part["col"], "inst": label[part["row"] - r0, part["col"] - c0]})

    return marked.select("scene", "row", "col", "palm", F.col("p").cast("double").alias("p"), "seed_id", *([group] if group != "scene" else [])).groupBy(group).applyInPandas(one, INSTANCE)


def instance_stats(instances: DataFrame, p: str | None = "p", by: tuple = ("scene", "inst")) -> DataFrame:
    """Pixel count, mean row and column, mean probability (1 without a heatmap) of each instance but 0."""
    conf = F.coalesce(F.avg(p), F.lit(1.0)) if p else F.lit(1.0)
    return instances.filter(F.col("inst") > 0).groupBy(*by).agg(F.count(F.lit(1)).alias("n_px"), F.avg("row").alias("cy"), F.avg("col").alias("cx"), conf.alias("confidence"))


def trace(mask: np.ndarray) -> np.ndarray:
    """Outer contour (x, y) through pixel centres of the component whose first pixel in raster order is set, by Moore tracing."""
    m = np.pad(mask.astype(bool), 1)
    r, c = (int(v[0]) for v in np.nonzero(m))
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    out, at, came = [(c - 1, r - 1)], (r, c), 6  # entered from the left
    first_move = None
    for _ in range(4 * m.size + 8):
        for k in range(1, 9):
            d = (came + k) % 8
            nxt = at[0] + ring[d][0], at[1] + ring[d][1]
            if m[nxt]:
                break
        else:
            return np.array(out)
        if first_move is None:
            first_move = (at, d)
        elif (at, d) == first_move:
            return np.array(out[:-1]) if len(out) > 1 else np.array(out)
        out.append((nxt[1] - 1, nxt[0] - 1))
        at, came = nxt, (d + 4) % 8
    raise AssertionError("the contour doesn't close")


def contour_metrics(ring: np.ndarray) -> tuple[float, float]:
    """Area and perimeter of a closed ring of points."""
    x, y = ring[:, 0].astype(float), ring[:, 1].astype(float)
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    return abs(float((x * y2 - x2 * y).sum())) / 2, float(np.hypot(x2 - x, y2 - y).sum())


def parts_of(mask: np.ndarray) -> list[np.ndarray]:
    """Masks of the 8-connected components, in raster order of their first pixels."""
    left, out = mask.astype(bool).copy(), []
    while left.any():
        r, c = (int(v[0]) for v in np.nonzero(left))
        stack, part = [(r, c)], np.zeros_like(left)
        left[r, c] = False
        while stack:
            r, c = stack.pop()
            part[r, c] = True
            for y in range(max(0, r - 1), min(left.shape[0], r + 2)):
                for x in range(max(0, c - 1), min(left.shape[1], c + 2)):
                    if left[y, x]:
                        left[y, x] = False
                        stack.append((y, x))
        out.append(part)
    return out


CONTOUR = "scene string, inst int, area_px double, perimeter double, ring array<struct<x:double,y:double>>"


def contours(instances: DataFrame) -> DataFrame:
    """Largest outer contour of each instance: scene, inst, area_px, perimeter, ring. An instance's pixels are one task's group."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        mask, r0, c0 = to_array(part.assign(_m=True), "_m", False)
        rings = [trace(m) for m in parts_of(mask)]
        ring = max(rings, key=lambda r: contour_metrics(r)[0])
        area, perimeter = contour_metrics(ring)
        points = [{"x": float(x + c0), "y": float(y + r0)} for x, y in ring]
        return pd.DataFrame({"scene": [part["scene"].iloc[0]], "inst": [part["inst"].iloc[0]], "area_px": [area], "perimeter": [perimeter], "ring": [points]})

    return instances.filter(F.col("inst") > 0).select("scene", "row", "col", "inst").groupBy("scene", "inst").applyInPandas(one, CONTOUR)


def trees(instances: DataFrame, p: str | None = "p", min_area: float = 9, min_circularity: float = 0.0) -> DataFrame:
    """Instances with metrics: scene, inst, n_px, cy, cx, area_px, confidence, circularity, ring.

    Dropped: pixel count below min_area, then contour area below it, then circularity below its bound.
    """
    stats = instance_stats(instances, p).filter(F.col("n_px") >= min_area)
    some = instances.join(stats.select("scene", "inst"), ["scene", "inst"], "left_semi")
    full = stats.join(contours(some), ["scene", "inst"]).withColumn("circularity", circularity("area_px", "perimeter"))
    return full.filter((F.col("area_px") >= min_area) & (F.col("circularity") >= min_circularity)).drop("perimeter")


def crowns(tree: DataFrame, transform: tuple, geometry: str = "circle", quad_segs: int = 16, simplify_px: float = 0.5) -> DataFrame:
    """Georeferenced crown layer: scene, id, score, circularity, diam_m, area_px, ring (map coordinates).

    geometry circle: a circle of the contour's area around the centroid; anything else: the contour, simplified. Rings
    of fewer than three points are dropped. id is the instance's place in its scene, from 0.
    """
    from pyspark.sql import Window

    t = tree.withColumn("id", (F.row_number().over(Window.partitionBy("scene").orderBy("inst")) - 1).cast("long"))
    if geometry == "circle":
        t = t.withColumn("ring", circle_ring("cx", "cy", "area_px", quad_segs))
    else:
        t = t.filter(F.size("ring") >= 3)
        t = simplify(t, simplify_px).filter(F.size("ring") >= 4)
    return t.select("scene", "id", F.round("confidence", 4).alias("score"), F.round("circularity", 4).alias("circularity"), F.round(crown_diameter("area_px", pixel_size(transform)), 3).alias("diam_m"), F.round("area_px", 1).alias("area_px"), transform_ring("ring", transform).alias("ring"))


def simplify_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a ring, cut at its first point and the one farthest from it."""
    if len(ring) < 4 or tolerance <= 0:
        return ring

    def keep(i: int, j: int) -> list[int]:
        if j - i < 2:
            return []
        a, b, mid = pts[i], pts[j], pts[i + 1 : j]
        d = b - a
        n = np.hypot(*d)
        away = np.hypot(*(mid - a).T) if n == 0 else np.abs(d[0] * (mid[:, 1] - a[1]) - d[1] * (mid[:, 0] - a[0])) / n
        k = int(away.argmax())
        return [] if away[k] <= tolerance else [*keep(i, i + 1 + k), i + 1 + k, *keep(i + 1 + k, j)]

    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    pts = np.vstack([ring, ring[:1]])
    return ring[[0, *keep(0, far), far, *keep(far, len(ring))]]


def simplify(rows: DataFrame, tolerance: float, ring: str = "ring") -> DataFrame:
    """Close and simplify the rings of all rows."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(col: pd.Series) -> pd.Series:
        out = []
        for r in col:
            pts = np.array([(q["x"], q["y"]) for q in r], float).reshape(-1, 2)
            if len(pts) > 1 and (pts[0] == pts[-1]).all():
                pts = pts[:-1]
            pts = simplify_ring(pts, tolerance)
            out.append([{"x": x, "y": y} for x, y in [*pts.tolist(), *pts[:1].tolist()]])
        return pd.Series(out)

    return rows.withColumn(ring, run(F.col(ring)))


POLYGON = "scene string, comp long, area double, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"


def run_rings(part: np.ndarray, row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Closed rings of pixel edges around each part's runs of pixels (set pixels to the right of the direction), many parts at once.

    A run covers columns c0 to c1 of a row; a part's runs are disjoint. Returns x and y of the rings' corners one ring after the other,
    where each ring begins (and the last one ends), and its part. A part's rings lie together, the outer one first, then holes in raster order.
    Where a part's pixels share only a corner, rings turn right, which keeps 4-connected parts apart.
    """
    n = len(row)
    # Each run has an edge up at its left and one down at its right; an end that doesn't go on straight is a corner.
    k = np.concatenate([part] * 4).astype(np.int64)
    x = np.concatenate([c0, c1 + 1] * 2).astype(np.int64)
    y = np.concatenate([row, row, row + 1, row + 1]).astype(np.int64)
    up = np.tile(np.repeat([True, False], n), 2)
    above = np.repeat([False, True], 2 * n)  # the edge lies above this end
    order = np.lexsort((up, x, y, k))  # of two corners at a place, the one whose horizontal edge goes left comes first
    k, x, y, up, above = k[order], x[order], y[order], up[order], above[order]
    on = (k[1:] == k[:-1]) & (y[1:] == y[:-1]) & (x[1:] == x[:-1]) & (up[1:] == up[:-1])
    corner = ~(np.append(on, False) | np.append(False, on))[: len(k)]
    k, x, y, up, above = k[corner], x[corner], y[corner], up[corner], above[corner]
    # Along a line corners pair up: by horizontal edges in this order, by vertical ones in that of the columns.
    here = np.arange(len(k))
    by_column = np.lexsort((~above, y, x, k))
    below = np.empty_like(here)
    below[by_column] = by_column[here ^ 1]
    after = np.where(up != above, here ^ 1, below).tolist()
    at, begins = [], []
    seen = bytearray(len(after))
    for start in range(len(after)):
        if not seen[start]:
            begins.append(len(at))
            i = start
            while not seen[i]:
                seen[i] = 1
                at.append(i)
                i = after[i]
            at.append(start)
    at, begins = np.array(at, np.int64), np.array([*begins, len(at)], np.int64)
    return x[at], y[at], begins, k[at[begins[:-1]]]


def edge_rings(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Rings of a mask's pixel edges, see run_rings, as lists of corners (x, y)."""
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, c0), c1 = np.nonzero(step == 1), np.nonzero(step == -1)[1] - 1
    x, y, at, _ = run_rings(np.zeros_like(row), row, c0, c1)
    return [list(zip(x[i:j].tolist(), y[i:j].tolist(), strict=True)) for i, j in zip(at[:-1], at[1:], strict=True)]


def _polygons(runs: pa.RecordBatch, starts: np.ndarray, simplify_px: float) -> pa.RecordBatch:
    """Rows of POLYGON of whole components, whose runs lie together and begin at ``starts``."""
    row, c0, c1 = (runs[c].to_numpy().astype(np.int64) for c in ("row", "c0", "c1"))
    part = np.zeros(len(row), np.int64)
    part[starts[1:]] = 1
    x, y, at, of = run_rings(np.cumsum(part), row, c0, c1)
    if simplify_px > 0:
        rings = [simplify_ring(np.column_stack([x[i : j - 1], y[i : j - 1]]).astype(float), simplify_px) for i, j in zip(at[:-1], at[1:], strict=True)]
        x, y = np.concatenate([np.vstack([r, r[:1]]) for r in rings]).T
        at = np.cumsum([0, *(len(r) + 1 for r in rings)])
    points = pa.StructArray.from_arrays([pa.array(x.astype(float)), pa.array(y.astype(float))], ["x", "y"])
    ring = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), points)
    outer = np.append(True, of[1:] != of[:-1])
    holes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of[~outer], minlength=len(starts)))).astype(np.int32)), ring.filter(pa.array(~outer)))
    area = pa.array(np.add.reduceat(c1 - c0 + 1, starts).astype(float))
    first = pa.array(starts)
    return pa.RecordBatch.from_arrays([runs["scene"].take(first), runs["comp"].take(first), area, ring.filter(pa.array(outer)), holes], ["scene", "comp", "area", "ring", "holes"])


def mask_polygons(px: DataFrame, class_value: int = 1, transform: tuple = (1, 0, 0, 0, 1, 0), simplify_px: float = 0.0) -> DataFrame:
    """One polygon with holes for each 4-connected component of a class, along pixel edges: scene, comp, area (pixels), ring, holes.

    Components come to Python as runs of pixels, those of a batch together; one component is a task's work.
    """
    from loomgrid.operators.seeds import component_runs

    runs = component_runs(px.filter(F.col("cls") == class_value).select("scene", "row", "col"), 1).select("scene", "comp", "row", "c0", "c1")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # the last component's runs; it may go on in the next batch

        def whole() -> Iterator[pa.RecordBatch]:
            runs = pa.concat_batches(held)
            starts = np.flatnonzero(np.append(True, _differs(runs)))
            yield _polygons(runs, starts, simplify_px)

        for batch in filter(len, batches):
            new = np.flatnonzero(_differs(pa.concat_batches([held[-1].slice(len(held[-1]) - 1), batch]) if held else batch))
            if len(new):
                end = int(new[-1]) + (not held)
                held.append(batch.slice(0, end))
                yield from whole()
                held = []
                batch = batch.slice(end)
            held.append(batch)
        if held:
            yield from whole()

    out = runs.repartition("scene", "comp").sortWithinPartitions("scene", "comp").mapInArrow(traced, POLYGON)
    return out.withColumn("ring", transform_ring("ring", transform)).withColumn("holes", F.transform("holes", lambda h: transform_ring(h, transform)))


def _differs(runs: pa.RecordBatch) -> np.ndarray:
    """Whether each run but the first is of another component than the one before."""
    n = len(runs) - 1
    scene, comp = runs["scene"], runs["comp"].to_numpy()
    return pc.not_equal(scene.slice(1), scene.slice(0, n)).to_numpy(zero_copy_only=False) | (comp[1:] != comp[:-1])


def largest_part(parts: DataFrame, by: str, part: str, ring: str = "ring") -> DataFrame:
    """Of the parts of each multi-part polygon the one with the largest ring, the least ``part`` among those whose areas agree to six places."""
    best = F.max_by(F.struct(*[c for c in parts.columns if c != by]), F.struct(F.round(ring_area(ring), 6), -F.col(part)))
    return parts.groupBy(by).agg(best.alias("_best")).select(by, "_best.*")
