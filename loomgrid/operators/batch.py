"""Batches of scenes: pairing, resume, isolated failures, totals."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.sources.rasters import stem

STATUS = "file string, status string, tree_count long, error string"


def pair_heatmaps(labels: DataFrame, heatmaps: DataFrame, label_suffix: str = "_label", heatmap_suffix: str = "_prob") -> DataFrame:
    """Label names with the heatmap of the same stem, or null: name, stem, heatmap."""
    cut = lambda suffix: F.regexp_replace(stem(F.col("name")), f"{suffix}$", "")
    left = labels.select("name", cut(label_suffix).alias("stem"))
    right = heatmaps.filter(F.endswith(stem(F.col("name")), F.lit(heatmap_suffix))).select(F.col("name").alias("heatmap"), cut(heatmap_suffix).alias("stem"))
    return left.join(right, "stem", "left")


def pending(files: DataFrame, done: DataFrame, key: str = "stem") -> tuple[DataFrame, DataFrame]:
    """Files still to process and files whose output exists."""
    return files.join(done.select(key).distinct(), key, "left_anti"), files.join(done.select(key).distinct(), key, "left_semi")


def run_batch(pixels: DataFrame, work: Callable[[pd.DataFrame], int], by: str = "file") -> DataFrame:
    """Apply ``work`` to the pixels of each file, one task each; an error becomes a failed row and the others go on."""

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        try:
            row = (str(key[0]), "ok", int(work(part)), None)
        except Exception as e:  # a file's failure is its result
            row = (str(key[0]), "failed", None, f"{type(e).__name__}: {e}")
        return pd.DataFrame([row], columns=["file", "status", "tree_count", "error"]).astype({"tree_count": "Int64"})

    return pixels.groupBy(by).applyInPandas(one, STATUS)


def totals(batch: DataFrame) -> DataFrame:
    """One row: processed, skipped, failed, trees."""
    n = lambda s: F.count_if(F.col("status") == s)
    return batch.agg(n("ok").alias("processed"), n("skipped").alias("skipped"), n("failed").alias("failed"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("tree_count"))), F.lit(0)).alias("trees"))
