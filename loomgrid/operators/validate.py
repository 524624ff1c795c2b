"""Dataset and configuration checks, as rows of problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def require_grid(px: DataFrame, keys: tuple = ("row", "col")) -> tuple[int, int]:
    """Height and width of a full grid of pixels; an error when cells are missing or repeated."""
    h, w, n, d = px.agg(F.max("row") - F.min("row") + 1, F.max("col") - F.min("col") + 1, F.count(F.lit(1)), F.count_distinct(*keys)).first()
    if n != d or n != (h or 0) * (w or 0):
        raise ValueError(f"not a 2-D grid: {n} pixels, {d} places, {h} x {w}")
    return h, w


def require_same_shape(a: DataFrame, b: DataFrame) -> None:
    sa, sb = require_grid(a), require_grid(b)
    if sa != sb:
        raise ValueError(f"shapes differ: {sa} and {sb}")


def grid_facts(px: DataFrame, by: str = "scene") -> DataFrame:
    """Per scene: height, width, pixels, and whether the grid is full."""
    h, w = F.max("row") - F.min("row") + 1, F.max("col") - F.min("col") + 1
    return px.groupBy(by).agg(h.cast("long").alias("height"), w.cast("long").alias("width"), F.count(F.lit(1)).alias("pixels"), (F.count(F.lit(1)) == h * w).alias("full"))


def unpaired(images: DataFrame, masks: DataFrame, key: str = "stem") -> DataFrame:
    """Images without mask and masks without image: side, n, examples (the first three, sorted)."""
    a = images.select(key).distinct().join(masks.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("image without mask"))
    b = masks.select(key).distinct().join(images.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("mask without image"))
    ranked = a.unionAll(b).withColumn("k", F.row_number().over(Window.partitionBy("side").orderBy(key)))
    few = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", key)))), lambda s: s[key])
    return ranked.groupBy("side").agg(F.count(F.lit(1)).alias("n"), few.alias("examples"))


def first_n(names: DataFrame, n: int = 50, by: str = "split", name: str = "name") -> DataFrame:
    """The first n names of each split."""
    return names.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(name))).filter(F.col("k") <= n).drop("k")


def value_histogram(masks: DataFrame, top: int = 6) -> DataFrame:
    """How many masks hold each value; the most frequent first, smaller values first among equals."""
    return masks.groupBy("value").agg(F.count_distinct("mask").alias("masks")).orderBy(F.desc("masks"), "value").limit(top)


def out_of_range(masks: DataFrame, n_classes: int, ignore: int = 255) -> DataFrame:
    """Mask values that are neither a class nor the ignored value, with their pixel counts."""
    return masks.filter((F.col("value") != ignore) & ~F.col("value").between(0, n_classes - 1)).groupBy("value").agg(F.count(F.lit(1)).alias("px"))


def check_dataset(images: DataFrame, masks: DataFrame, bands: DataFrame, n_classes: int, expected_bands: int) -> DataFrame:
    """Problems of a training folder: check, detail, n. images, masks: split, stem; masks hold value per pixel; bands: stem, n_bands."""
    pairs = unpaired(images.select(F.concat_ws("/", "split", "stem").alias("stem")), masks.select(F.concat_ws("/", "split", "stem").alias("stem")))
    a = pairs.select(F.col("side").alias("check"), F.array_join("examples", ", ").alias("detail"), "n")
    b = bands.filter(F.col("n_bands") != expected_bands).groupBy("n_bands").agg(F.count(F.lit(1)).alias("n")).select(F.lit("band count").alias("check"), F.col("n_bands").cast("string").alias("detail"), "n")
    c = out_of_range(masks, n_classes).select(F.lit("mask value").alias("check"), F.col("value").cast("string").alias("detail"), F.col("px").alias("n"))
    return a.unionAll(b).unionAll(c)


def repeated(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each repeat of a key after its first."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("k > 1").drop("k")


def repeated_values(rows: DataFrame, key: str) -> DataFrame:
    """One row: whether values of ``key`` repeat."""
    return rows.agg((F.count_distinct(key) != F.count(key)).alias("repeated"))


def crs_count(rows: DataFrame) -> DataFrame:
    n = F.count_distinct("crs")
    return rows.agg(n.alias("n"), (n > 1).alias("mixed"))


def preflight(jobs: DataFrame, classes: DataFrame) -> DataFrame:
    """All configuration errors at once: rule, subject. jobs: name, tile, overlap, n_sources, split, split_file, split_field."""
    rules = [
        ("no sources", F.col("n_sources") == 0),
        ("overlap not below tile size", F.col("overlap") >= F.col("tile")),
        ("negative overlap", F.col("overlap") < 0),
        ("neither split nor split file", F.col("split").isNull() & F.col("split_file").isNull()),
        ("unknown split", F.col("split").isNotNull() & ~F.col("split").isin("train", "val", "test")),
        ("split file without field", F.col("split_file").isNotNull() & F.col("split_field").isNull()),
    ]
    found = F.explode(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules]), lambda x: x.isNotNull()))
    per_job = jobs.select(found.alias("rule"), F.col("name").alias("subject"))
    names = repeated(jobs, "name", "tile").select(F.lit("repeated job name").alias("rule"), F.col("name").alias("subject"))
    values = repeated(classes, "cls", "class_name").select(F.lit("repeated class value").alias("rule"), F.col("class_name").alias("subject"))
    low = classes.filter("cls < 1").select(F.lit("class value below 1").alias("rule"), F.col("class_name").alias("subject"))
    return per_job.unionAll(names).unionAll(values).unionAll(low)


def require(problems: DataFrame) -> None:
    """Raise one error that names all problems (the first hundred)."""
    rows = problems.limit(100).collect()
    if rows:
        raise ValueError("; ".join(" ".join(map(str, r)) for r in rows))
