"""The model registry as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Model ids with modality; those of family mask2former give masks only.
MODELS = (
    ("segformer_b3_ms", "ms"), ("segformer_b5_ms", "ms"), ("upernet_swin_s_ms", "ms"), ("upernet_swin_b_ms", "ms"), ("upernet_vit_deit_s_ms", "ms"),
    ("uniformer_fpn_global_ms", "ms"), ("uniformer_xs_ms", "ms"), ("mask2former_swin_b_ms", "ms"), ("mask2former_swin_s_ms", "ms"),
    ("segformer_b3_rgb", "rgb"), ("upernet_swin_t_rgb", "rgb"), ("upernet_vit_deit_s_rgb", "rgb"), ("uniformer_xs_rgb", "rgb"), ("mask2former_swin_t_rgb", "rgb"),
)


def models(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(MODELS), "model_id string, modality string")
    family = F.substring_index("model_id", "_", 1)
    return rows.withColumn("family", family).withColumn("heatmap_capable", family != "mask2former")


def resolve(wanted: DataFrame) -> DataFrame:
    """Entries of the wanted model_ids; see unknown for the others."""
    return wanted.join(F.broadcast(models(wanted.sparkSession)), "model_id")  # fourteen rows


def unknown(wanted: DataFrame) -> DataFrame:
    return wanted.join(F.broadcast(models(wanted.sparkSession)), "model_id", "left_anti").select("model_id").distinct()
