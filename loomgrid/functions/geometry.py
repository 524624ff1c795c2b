"""Affine, circle and box geometry as column expressions.

A transform is six numbers a..f: X = a*col + b*row + c, Y = d*col + e*row + f.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def apply_affine(col: Column | str, row: Column | str, transform: tuple) -> tuple[Column, Column]:
    """Map coordinates of a pixel index (no half-pixel shift)."""
    a, b, c, d, e, f = transform
    col, row = as_column(col), as_column(row)
    return col * F.lit(float(a)) + row * F.lit(float(b)) + F.lit(float(c)), col * F.lit(float(d)) + row * F.lit(float(e)) + F.lit(float(f))


def invert_affine(x: Column | str, y: Column | str, transform: tuple) -> tuple[Column, Column]:
    """Pixel (col, row) of map coordinates, not rounded."""
    a, b, c, d, e, f = map(float, transform)
    det = a * e - b * d
    if not det:
        raise ValueError("the transform can't be inverted")
    dx, dy = as_column(x) - F.lit(c), as_column(y) - F.lit(f)
    return (dx * F.lit(e) - dy * F.lit(b)) / F.lit(det), (dy * F.lit(a) - dx * F.lit(d)) / F.lit(det)


def pixel_size(transform: tuple) -> float:
    """sqrt(|a * e|); rotation is ignored."""
    return math.sqrt(abs(transform[0] * transform[4]))


def crown_diameter(area_px: Column | str, pixel_size_m: float) -> Column:
    """Diameter of the circle with the crown's area, in map units."""
    return 2 * F.sqrt(as_column(area_px) * F.lit(float(pixel_size_m) ** 2) / F.lit(math.pi))


def circularity(area: Column | str, perimeter: Column | str) -> Column:
    """4 pi A / P^2, 0 where the perimeter is 0."""
    p = as_column(perimeter)
    return F.when(p == 0, F.lit(0.0)).otherwise(4 * math.pi * as_column(area) / (p * p))


def circle_ring(cx: Column | str, cy: Column | str, area: Column | str, quad_segs: int = 16) -> Column:
    """Closed ring of 4 * quad_segs points on the circle of the area, which counts as 1 at least."""
    r = F.sqrt(F.greatest(as_column(area), F.lit(1.0)) / F.lit(math.pi))
    n = 4 * quad_segs
    point = lambda k: F.struct((as_column(cx) + r * F.cos(-2 * math.pi * (k % n) / n)).alias("x"), (as_column(cy) + r * F.sin(-2 * math.pi * (k % n) / n)).alias("y"))
    return F.transform(F.sequence(F.lit(0), F.lit(n)), point)


def transform_ring(ring: Column | str, transform: tuple) -> Column:
    """Apply a transform to every point of a ring of structs x (column), y (row)."""

    def moved(p: Column) -> Column:
        x, y = apply_affine(p["x"], p["y"], transform)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(as_column(ring), moved)


def ring_area(ring: Column | str) -> Column:
    """Shoelace area of a closed ring of structs x, y, taken from its first point, so that large map coordinates cost no digits."""
    ring = as_column(ring)
    o = F.element_at(ring, 1)
    ahead = F.slice(ring, 2, F.size(ring) - 1)
    cross = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), ahead, lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"]))
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def point_in_ring(x: Column, y: Column, ring: Column | str) -> Column:
    """Even-odd rule for a closed ring of structs x, y."""
    ring = as_column(ring)
    ahead = F.slice(ring, 2, F.size(ring) - 1)
    crossed = lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
    hits = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), ahead, lambda a, b: F.when(crossed(a, b), 1).otherwise(0))
    return F.aggregate(hits, F.lit(0), lambda s, k: s + k) % 2 == 1


def box_ring(x0: Column | str, y0: Column | str, x1: Column | str, y1: Column | str) -> Column:
    point = lambda x, y: F.struct(as_column(x).cast("double").alias("x"), as_column(y).cast("double").alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def overlap_area(a: str, b: str) -> Column:
    """Area that the boxes of two aliased tables (x0, y0, x1, y1) share, at least 0."""
    c = lambda t, k: F.col(f"{t}.{k}")
    w = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    h = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_iou(a: str, b: str) -> Column:
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    inter = overlap_area(a, b)
    return inter / (area(a) + area(b) - inter)


def shared_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area inside both of two closed rings (points in rows, even-odd rule), exactly.

    The plane is cut into vertical slabs at all corners and all crossings of edges. Within a slab no edges cross, so the
    length common to both on its middle line, times its width, is its share.
    """
    low, high = max(a[:, 0].min(), b[:, 0].min()), min(a[:, 0].max(), b[:, 0].max())
    if low >= high or a[:, 1].min() >= b[:, 1].max() or b[:, 1].min() >= a[:, 1].max():
        return 0.0
    p, q = a[:-1, None], b[None, :-1]
    d, e = a[1:, None] - p, b[None, 1:] - q
    cross = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
    w = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = ((w[..., 0] * k[..., 1] - w[..., 1] * k[..., 0]) / cross for k in (e, d))
    met = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    x = np.unique(np.concatenate([a[:, 0], b[:, 0], (p[..., 0] + np.where(met, t, 0) * d[..., 0])[met]]))
    x = x[(x >= low) & (x <= high)]
    total, step = 0.0, max(1, 1_000_000 // (len(a) + len(b)))  # slabs at once
    for k in range(0, len(x) - 1, step):
        cuts = x[k : k + step + 1]
        middle, inside = (cuts[:-1] + cuts[1:]) / 2, []
        for ring in (a, b):
            (x0, y0), (x1, y1) = ring[:-1].T, ring[1:].T
            on = (x0 < middle[:, None]) != (x1 < middle[:, None])
            y = np.full(on.shape, np.inf)
            slab, edge = np.nonzero(on)
            y[on] = y0[edge] + (middle[slab] - x0[edge]) / (x1[edge] - x0[edge]) * (y1[edge] - y0[edge])
            y.sort(axis=1)
            inside.append(y[:, : on.sum(axis=1).max()].reshape(len(middle), -1, 2))
        top, bottom = (pick(inside[0][:, :, None, i], inside[1][:, None, :, i]) for pick, i in ((np.minimum, 1), (np.maximum, 0)))
        common = np.subtract(top, bottom, out=np.zeros_like(top), where=top > bottom).sum(axis=(1, 2))
        total += ((cuts[1:] - cuts[:-1]) * common).sum()
    return float(total)


def clip_ring(points: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """The part of a closed ring inside a box, closed again; no points where nothing is left.

    The ring is cut by one side of the box after the other. Parts of a ring that falls apart stay joined by edges that run
    along the box and back, which have no area.
    """
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if len(points) < 4:
            return points[:0]
        a, b = points[:-1], points[1:]
        da, db = sign * (a[:, axis] - bound), sign * (b[:, axis] - bound)
        crossed = (da < 0) != (db < 0)
        t = np.where(crossed, da / np.where(crossed, da - db, 1), 0)[:, None]
        met = a + t * (b - a)
        met[:, axis] = bound
        # Per edge: the crossing, if there is one, then the edge's end, if it lies inside.
        both = np.stack([met, b], 1).reshape(-1, 2)[np.stack([crossed, db >= 0], 1).ravel()]
        points = np.concatenate([both, both[:1]])
    return points if len(points) > 3 else points[:0]


def clipped(ring: Column | str, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Closed rings of structs x, y cut to a box, with the boxes of what is left: a struct ring, x0..y1, null where no area is left.

    An Arrow UDF, for layers of regions.
    """

    @F.pandas_udf("ring array<struct<x:double,y:double>>, x0 double, y0 double, x1 double, y1 double")
    def cut(rings: pd.Series) -> pd.DataFrame:
        out = []
        for r in rings:
            p = clip_ring(np.array([(q["x"], q["y"]) for q in r], float).reshape(-1, 2), x0, y0, x1, y1)
            x, y = (p - p[:1]).T
            some = len(p) and (x[:-1] * y[1:] - x[1:] * y[:-1]).sum() != 0
            out.append(([{"x": u, "y": v} for u, v in p.tolist()], *p.min(0).tolist(), *p.max(0).tolist()) if some else (None,) * 5)
        return pd.DataFrame(out, columns=["ring", "x0", "y0", "x1", "y1"])

    return cut(as_column(ring))


def ring_bounds(ring: Column | str) -> dict[str, Column]:
    """The box x0, y0, x1, y1 of a ring."""
    xs, ys = F.transform(as_column(ring), lambda q: q["x"]), F.transform(as_column(ring), lambda q: q["y"])
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def common_area(a: Column | str, b: Column | str) -> Column:
    """Area inside both of two closed rings of structs x, y; an Arrow UDF, for few candidates."""

    @F.pandas_udf("double")
    def area(a: pd.Series, b: pd.Series) -> pd.Series:
        points = lambda r: np.array([(q["x"], q["y"]) for q in r], float).reshape(-1, 2)
        return pd.Series([shared_area(points(r), points(s)) for r, s in zip(a, b, strict=True)], dtype=float)

    return area(as_column(a), as_column(b))


def boxes_touch(a: str, b: str) -> Column:
    """Boxes intersect; a common edge or corner counts."""
    c = lambda t, k: F.col(f"{t}.{k}")
    return (c(a, "x0") <= c(b, "x1")) & (c(a, "x1") >= c(b, "x0")) & (c(a, "y0") <= c(b, "y1")) & (c(a, "y1") >= c(b, "y0"))
