"""Spatial joins by grid cells: boxes, radii, nearest seeds; greedy suppression as a fixpoint.

Plain range conditions would be planned as nested loops. Here both sides are put into
grid cells, meet by equality of cells, and are tested exactly; a pair is reported in one cell
only, so no distinct is needed.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.geometry import box_iou, boxes_touch, common_area, ring_area


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder; where none is set, a temporary one in local mode and an error on a cluster."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomgrid-"))
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """Joined by shuffle and sort. Spark's estimates don't see what explode adds, also through a checkpoint, so it would broadcast large tables from the driver."""
    return df.hint("merge")


def _cells(df: DataFrame, size: float) -> DataFrame:
    """A row for each cell that the box x0, y0, x1, y1 touches."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    return df.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))


def box_pairs(a: DataFrame, b: DataFrame, size: float, by: tuple = ()) -> DataFrame:
    """Pairs of boxes of ``a`` and ``b`` (x0, y0, x1, y1) that intersect or touch and agree in the columns ``by``, as columns a.* and b.*.

    size: side of a cell, best near the usual size of a box. A pair is kept in the cell of the lower corner of its common part.
    """
    pairs = _cells(a, size).alias("a").join(_cells(b, size).alias("b"), ["cx", "cy", *by]).filter(boxes_touch("a", "b"))
    home = (F.floor(F.greatest("a.x0", "b.x0") / size) == F.col("cx")) & (F.floor(F.greatest("a.y0", "b.y0") / size) == F.col("cy"))
    return pairs.filter(home)


def radius_pairs(points: DataFrame, radius: float, by: tuple = ()) -> DataFrame:
    """Pairs of different points (id, x, y) that agree in the columns ``by`` and are at most ``radius`` apart: a, b with a < b, and ``by``."""
    here = points.select(*by, "id", "x", "y", F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    around = here.select(*by, "id", "x", "y", F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")).select(*by, "id", "x", "y", "c.*")
    d2 = (F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2
    pairs = here.alias("a").join(around.alias("b"), ["cx", "cy", *by]).filter((F.col("a.id") < F.col("b.id")) & (d2 <= radius * radius))
    return pairs.select(*by, F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def greedy_survivors(rows: DataFrame, pairs: DataFrame, score: str, rounds: int = 1000, by: tuple = ()) -> DataFrame:
    """Greedy suppression: by falling score (then rising id) keep a row unless a kept one suppresses it.

    ``pairs`` (a, b) suppress each other. ids are told apart by the columns ``by`` of both tables as well (the scene), so all
    scenes go through the same rounds. Each round keeps the rows without a stronger undecided
    neighbour and drops their neighbours, which ends with the rows greedy visiting keeps. Returns ``rows`` of the survivors.
    """
    node = lambda c: F.struct(*by, F.col(c).alias("id"))
    strength = rows.select(node("id").alias("id"), F.struct(F.col(score).alias("s"), (-F.col("id")).alias("i")).alias("s"))
    pairs = pairs.select(node("a").alias("a"), node("b").alias("b"))
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = both.join(shuffled(strength.select(F.col("id").alias("a"), F.col("s").alias("sa"))), "a").join(shuffled(strength.select(F.col("id").alias("b"), F.col("s").alias("sb"))), "b")
    # Edges lead from the stronger to the weaker one.
    e = checkpointed(e.filter("sa > sb").select("a", "b"))
    dropped = None
    for _ in range(rounds):
        weaker = shuffled(e.select("b").distinct())
        tops = e.select("a").distinct().join(weaker, F.col("a") == F.col("b"), "left_anti")
        hit = e.join(shuffled(tops), "a", "left_semi").select("b").distinct()
        hit = checkpointed(hit)
        if hit.isEmpty():
            break
        dropped = hit if dropped is None else dropped.unionAll(hit)
        gone = shuffled(hit.withColumnRenamed("b", "x"))
        e = e.join(shuffled(tops.withColumnRenamed("a", "x")), F.col("a") == F.col("x"), "left_anti").join(gone, F.col("a") == F.col("x"), "left_anti").join(gone, F.col("b") == F.col("x"), "left_anti")
        e = checkpointed(e)
    else:
        raise RuntimeError(f"suppression isn't settled after {rounds} rounds")
    if dropped is None:
        return rows
    gone = dropped.select(*(F.col(f"b.{c}").alias(f"_{c}") for c in by), F.col("b.id").alias("_id"))
    on = F.col("id") == F.col("_id")
    for c in by:
        on &= F.col(c) == F.col(f"_{c}")
    return rows.join(shuffled(gone), on, "left_anti")


def suppress_close(seeds: DataFrame, radius: float, score: str = "strength", by: tuple = ()) -> DataFrame:
    """Seeds (id, x, y, score) left after stronger ones suppress all within the closed radius; 0 keeps all."""
    return seeds if radius <= 0 else greedy_survivors(seeds, radius_pairs(seeds, radius, by), score, by=by)


def deduplicate_boxes(crowns: DataFrame, iou: float, size: float, score: str = "score") -> DataFrame:
    """Crowns (id, x0, y0, x1, y1, score) left after better ones suppress those with IoU of at least ``iou``."""
    pairs = box_pairs(crowns, crowns, size).filter(F.col("a.id") < F.col("b.id")).filter(box_iou("a", "b") >= iou)
    return greedy_survivors(crowns, pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")), score)


def deduplicate_rings(crowns: DataFrame, iou: float, size: float, score: str = "score", by: tuple = ()) -> DataFrame:
    """Crowns (id, ring, x0, y0, x1, y1, score) left after better ones suppress those whose rings' IoU is at least ``iou``.

    Boxes give the candidates, the rings' true common area decides. Rings join the pairs found, so that they aren't copied into every cell.
    """
    boxes = shuffled(crowns.select(*by, "id", "x0", "y0", "x1", "y1"))
    pairs = box_pairs(boxes, boxes, size, by).filter(F.col("a.id") < F.col("b.id"))
    shared = F.col("shared")
    sides = pairs.select(*by, F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    for side in ("a", "b"):
        sides = sides.join(shuffled(crowns.select(*by, F.col("id").alias(f"id_{side}"), F.col("ring").alias(f"ring_{side}"))), [*by, f"id_{side}"])
    met = sides.withColumns({"shared": common_area("ring_a", "ring_b"), "both": ring_area("ring_a") + ring_area("ring_b")})
    close = met.filter(F.when(F.col("both") > shared, shared / (F.col("both") - shared)).otherwise(0.0) >= iou)
    return greedy_survivors(crowns, close.select(*by, F.col("id_a").alias("a"), F.col("id_b").alias("b")), score, by=by)


def nearest(points: DataFrame, seeds: DataFrame, cell: float, by: tuple = ()) -> DataFrame:
    """Nearest seed (smallest seed_id of equals) of each point, exactly: points' columns, inst, d2 (null where there is no seed).

    points have row, col; seeds have seed_id, row, col; both have the columns ``by`` (the scene), in which they must agree. A place looks at the
    seeds of the nine cells around it; a seed found within one cell's side is surely nearest. The others look again
    with cells twice as large. Points at one place, repeated ones included, share its answer.
    """
    place = [*by, "row", "col"]
    rest, out, size = points.select(*place).distinct(), None, cell
    if by:
        rest = rest.join(seeds.select(*by).distinct(), list(by), "left_semi")
    elif not seeds.limit(1).count():
        rest = rest.limit(0)
    s0 = seeds.select(*by, "seed_id", F.col("row").alias("sr"), F.col("col").alias("sc"))
    while True:
        around = [F.struct((F.floor(F.col("sr") / size) + i).alias("cr"), (F.floor(F.col("sc") / size) + j).alias("cc")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        s = s0.withColumn("c", F.explode(F.array(*around))).select(*by, "seed_id", "sr", "sc", "c.*")
        p = rest.filter("row is not null and col is not null").withColumns({"cr": F.floor(F.col("row") / size), "cc": F.floor(F.col("col") / size)})
        d2 = ((F.col("row") - F.col("sr")) ** 2 + (F.col("col") - F.col("sc")) ** 2).cast("double")
        best = p.join(s, [*by, "cr", "cc"], "left").groupBy(*place).agg(F.min(F.struct(d2.alias("d2"), F.col("seed_id").alias("seed_id"))).alias("m"))
        best = checkpointed(best.select(*place, F.col("m.seed_id").cast("int").alias("inst"), F.col("m.d2").alias("d2")))
        sure = best.filter(F.col("d2") <= size * size)
        out = sure if out is None else out.unionAll(sure)
        rest = best.filter(F.col("d2").isNull() | (F.col("d2") > size * size)).select(*place)
        if rest.isEmpty():
            return points.join(out, place, "left").select(*points.columns, "inst", "d2")
        size *= 2
