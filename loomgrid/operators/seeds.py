"""Seed detection: peaks, blur, distances, plateaus, snapping, suppression.

Neighbourhood maxima and blurs are separable window passes over (scene, col) and (scene, row): two
shuffles whatever the kernel, and no self-join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.spatial import checkpointed, shuffled, suppress_close


def _axis(over: str, along: str, scene: str, reach: int = 1):
    return Window.partitionBy(scene, over).orderBy(along).rangeBetween(-reach, reach)


def detect_peaks(px: DataFrame, surface: str = "p", connectivity: int = 2, scene: str = "scene") -> DataFrame:
    """Pixels that equal the largest of their neighbourhood (8 neighbours, or 4 with connectivity 1) and aren't a flat zero.

    Zero regions whose whole neighbourhood is zero are background; the border's outside counts as such.
    """
    s = F.col(surface)
    up = F.max(s).over(_axis("col", "row", scene))
    if connectivity == 2:
        m = px.withColumn("_v", up).withColumn("_m", F.max("_v").over(_axis("row", "col", scene)))
    else:
        m = px.withColumn("_v", up).withColumn("_m", F.greatest("_v", F.max(s).over(_axis("row", "col", scene))))
    z = (s == 0).cast("int")
    zeros = m.withColumn("_z", F.min(z).over(_axis("col", "row", scene)))
    low = zeros.withColumn("_e", F.min("_z").over(_axis("row", "col", scene)) if connectivity == 2 else F.least("_z", F.min(z).over(_axis("row", "col", scene))))
    return low.filter((s == F.col("_m")) != (F.col("_e") == 1)).drop("_v", "_m", "_z", "_e")


def gaussian_kernel(size: int) -> list[float]:
    """Odd-sized kernel with the usual sigma for a size; sizes 1, 3 and 5 are binomial."""
    size |= 1
    fixed = {1: [1.0], 3: [0.25, 0.5, 0.25], 5: [x / 16 for x in (1, 4, 6, 4, 1)]}
    if size in fixed:
        return fixed[size]
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return (k / k.sum()).tolist()


def blur(px: DataFrame, size: int, p: str = "p", scene: str = "scene") -> DataFrame:
    """Separable Gaussian blur with mirrored borders (the edge pixel isn't repeated) of a full grid."""
    if size <= 1:
        return px
    kernel = gaussian_kernel(size)
    half = len(kernel) // 2
    for over, along in (("col", "row"), ("row", "col")):
        line = Window.partitionBy(scene, over)
        w = line.orderBy(along)
        first, last = F.col(along) - F.min(along).over(line), F.max(along).over(line) - F.col(along)

        def shifted(o: int, w=w):
            return F.col(p) if o == 0 else F.lead(p, o).over(w) if o > 0 else F.lag(p, -o).over(w)

        total = F.lit(0.0)
        for k, weight in enumerate(kernel):
            d = k - half
            v = shifted(d)
            for near in range(abs(d)):  # pixels this near to the border read the mirrored place
                v = F.when((first if d < 0 else last) == near, shifted(-2 * near - d if d < 0 else 2 * near - d)).otherwise(v)
            total = total + v * weight
        px = px.withColumn(p, total)
    return px


def _runs(px: DataFrame, scene: str) -> DataFrame:
    """Adds ``_r``, the place among its row's runs of the run of adjacent pixels that a pixel lies in; a pixel given twice lies in one run."""
    w = Window.partitionBy(scene, "row").orderBy("col")
    breaks = F.when(F.col("col") - F.lag("col").over(w) <= 1, 0).otherwise(1)
    return px.withColumn("_b", breaks).withColumn("_r", F.sum("_b").over(w))


def component_runs(px: DataFrame, connectivity: int = 2, scene: str = "scene", rounds: int = 200) -> DataFrame:
    """Runs of adjacent pixels in a row (row, columns c0 to c1, their place _r in the row) with ``comp``, as components gives it.

    Runs of pixels in a row are joined first; then the smallest number spreads between touching runs, and
    each run jumps to its number's own number, so that long components settle in few rounds.
    """
    number = F.col("row").cast("long") * (1 << 31) + F.col("c0")
    spans = _runs(px, scene).groupBy(scene, "row", "_r").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).withColumn("id", number)
    spans = checkpointed(spans)
    reach = 1 if connectivity == 2 else 0
    below = spans.select(scene, (F.col("row") - 1).alias("row"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("id").alias("b"))
    # Runs of adjacent rows meet through the columns they cover, in blocks of 64.
    block = lambda a, b: F.explode(F.sequence(F.floor(a / 64), F.floor(b / 64)))
    e = spans.withColumn("k", block(F.col("c0") - reach, F.col("c1") + reach)).join(shuffled(below.withColumn("k", block(F.col("d0"), F.col("d1")))), [scene, "row", "k"])
    e = e.filter((F.col("c0") - reach <= F.col("d1")) & (F.col("d0") <= F.col("c1") + reach)).select(scene, F.col("id").alias("a"), "b").distinct()
    e = checkpointed(e.unionAll(e.select(scene, F.col("b").alias("a"), F.col("a").alias("b"))))
    label = checkpointed(spans.select(scene, "id", F.col("id").alias("comp")))
    for _ in range(rounds):
        near = e.join(shuffled(label.select(scene, F.col("id").alias("b"), "comp")), [scene, "b"]).groupBy(scene, F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        new = label.join(shuffled(near), [scene, "id"], "left").select(scene, "id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = label.select(scene, F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = checkpointed(new.join(shuffled(up), [scene, "comp"], "left").select(scene, "id", "old", F.least("comp", "up").alias("comp")))
        if new.filter("old <> comp").isEmpty():
            break
        label = new.drop("old")
    else:
        raise RuntimeError("components aren't settled")
    return spans.join(shuffled(label), [scene, "id"]).select(scene, "row", "_r", "c0", "c1", "comp")


def components(px: DataFrame, connectivity: int = 2, scene: str = "scene", keys: tuple = ("row", "col"), rounds: int = 200) -> DataFrame:
    """Adds ``comp``, the smallest pixel number of each connected component of the given pixels."""
    named = component_runs(px, connectivity, scene, rounds).select(scene, "row", "_r", "comp")
    return _runs(px, scene).join(shuffled(named), [scene, "row", "_r"]).drop("_b", "_r")


def plateau_seeds(peaks: DataFrame, scene: str = "scene") -> DataFrame:
    """One seed per component of peaks: the centroid, rounded half to even, or the nearest pixel of the component.

    The centroid counts when it is any peak; else the component's pixel at the least city-block distance, the first in raster order.
    Returns scene, comp, row, col.
    """
    comp = checkpointed(components(peaks, 2, scene))
    centre = comp.groupBy(scene, "comp").agg(F.rint(F.avg("row")).cast("int").alias("cr"), F.rint(F.avg("col")).cast("int").alias("cc"))
    on_peak = comp.select(scene, F.col("row").alias("cr"), F.col("col").alias("cc"), F.lit(True).alias("on"))
    centre = centre.join(shuffled(on_peak), [scene, "cr", "cc"], "left")
    d = F.abs(F.col("row") - F.col("cr")) + F.abs(F.col("col") - F.col("cc"))
    snapped = comp.join(shuffled(centre.filter("on is null")), [scene, "comp"]).groupBy(scene, "comp").agg(F.min(F.struct(d.alias("d"), F.col("row"), F.col("col"))).alias("m"))
    kept = centre.filter("on").select(scene, "comp", F.col("cr").alias("row"), F.col("cc").alias("col"))
    return kept.unionAll(snapped.select(scene, "comp", "m.row", "m.col"))


def squared_distance(mask: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distance to the nearest false pixel: columns first, then the least over rows of each row's parabolas."""
    h, w = mask.shape
    far = (h + w) ** 2
    up = np.where(mask, h + w, 0)
    for r in range(1, h):
        up[r] = np.minimum(up[r], up[r - 1] + 1)
    for r in range(h - 2, -1, -1):
        up[r] = np.minimum(up[r], up[r + 1] + 1)
    g = up.astype(np.int64) ** 2
    x = np.arange(w)
    out = np.full((h, w), far, np.int64)
    for c in range(w):
        out = np.minimum(out, g[:, c : c + 1] + (x - c)[None, :] ** 2)
    return out


def to_array(part: pd.DataFrame, value: str, fill=0) -> tuple[np.ndarray, int, int]:
    r0, c0 = int(part["row"].min()), int(part["col"].min())
    out = np.full((int(part["row"].max()) - r0 + 1, int(part["col"].max()) - c0 + 1), fill, dtype=part[value].to_numpy().dtype)
    out[part["row"] - r0, part["col"] - c0] = part[value]
    return out, r0, c0


def distance_transform(px: DataFrame, mask: str = "palm", scene: str = "scene") -> DataFrame:
    """Adds ``dist``, the Euclidean distance of mask pixels to the nearest pixel of the scene outside it (0 elsewhere). One task per scene."""
    columns = [f for f in px.schema.fields if f.name != "dist"]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        m, r0, c0 = to_array(part, mask, False)
        d = np.sqrt(squared_distance(m.astype(bool)))
        return part.assign(dist=d[part["row"] - r0, part["col"] - c0])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", dist double"
    return px.groupBy(scene).applyInPandas(one, schema)


def find_seeds(px: DataFrame, has_heatmap: bool = True, blur_size: int = 5, prob_threshold: float | None = 0.5, min_distance: float = 0, scene: str = "scene") -> DataFrame:
    """Seeds of each scene: scene, seed_id (from 1, in raster order), row, col, strength.

    px: scene, row, col, palm, p. Threshold, then blur, then peaks inside the mask; without a heatmap the distance to the background takes p's place.
    """
    if has_heatmap:
        s = px.withColumn("_s", F.when(F.col("p") > prob_threshold, F.col("p")).otherwise(0.0) if prob_threshold is not None else F.col("p"))
        s = blur(s, blur_size, "_s", scene)
    else:
        s = distance_transform(px, "palm", scene).withColumn("_s", F.col("dist"))
    peaks = detect_peaks(s, "_s", 2, scene).filter("palm")
    seeds = plateau_seeds(peaks.select(scene, "row", "col"), scene).join(s.select(scene, "row", "col", F.col("_s").alias("strength")), [scene, "row", "col"])
    number = F.row_number().over(Window.partitionBy(scene).orderBy("row", "col"))
    seeds = checkpointed(seeds.select(scene, number.cast("int").alias("seed_id"), "row", "col", "strength"))
    if min_distance > 0:
        points = seeds.select(scene, F.col("seed_id").alias("id"), F.col("col").alias("x"), F.col("row").alias("y"), "strength")
        seeds = suppress_close(points, min_distance, by=(scene,)).select(scene, F.col("id").alias("seed_id"), F.col("y").alias("row"), F.col("x").alias("col"), "strength")
    return seeds
