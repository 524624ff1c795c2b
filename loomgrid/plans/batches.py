"""Batches of scenes through the whole plan, with resume and isolated failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.batch import pending
from loomgrid.operators.spatial import checkpointed
from loomgrid.operators.validate import grid_facts
from loomgrid.plans.extract import extract


def batch_extract(px: DataFrame, transform: tuple, done: DataFrame | None = None, palm_class: int = 1, **tuning) -> tuple[DataFrame, DataFrame]:
    """Crown layer of many scenes (scene, row, col, cls, p) and a summary: file, status, tree_count, error.

    All scenes go through one plan. A scene whose pixels are no full grid, or have no class, is reported as failed and
    the others go on; scenes named in ``done`` (scene) are skipped. A scene without trees is ok with 0.
    """
    facts = grid_facts(px).join(px.groupBy("scene").agg(F.count_if(F.col("cls").isNull()).alias("unlabelled")), "scene")
    why = F.when(~F.col("full"), "ValueError: not a 2-D grid").when(F.col("unlabelled") > 0, "ValueError: pixels without class")
    facts = checkpointed(facts.select("scene", why.alias("error")))
    todo, old = pending(facts, done, "scene") if done is not None else (facts, facts.limit(0))
    good = todo.filter("error is null").select("scene")
    layer = checkpointed(extract(px.join(good, "scene", "left_semi"), transform, palm_class, **tuning))
    counts = good.join(layer.groupBy("scene").agg(F.count(F.lit(1)).alias("n")), "scene", "left")
    none = F.lit(None).cast("string")
    rows = counts.select(F.col("scene").alias("file"), F.lit("ok").alias("status"), F.coalesce("n", F.lit(0)).alias("tree_count"), none.alias("error"))
    bad = todo.filter("error is not null").select("scene", F.lit("failed"), F.lit(None).cast("long"), "error")
    return layer, rows.unionAll(bad).unionAll(old.select("scene", F.lit("skipped"), F.lit(None).cast("long"), none))
