"""Raster and vector views over the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_NAMES = ("train", "val", "test")


class Views:
    """Lazily read tables of one folder, seen as rasters and layers."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def px(self) -> DataFrame:
        """scene, row, col, p, cls, palm: orders on a grid 50 wide."""
        o = self.table("orders")
        cls = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
        return o.select(F.lit("s").alias("scene"), F.floor(F.col("o_orderkey") / 50).cast("int").alias("row"), (F.col("o_orderkey") % 50).cast("int").alias("col"), (F.col("o_totalprice") / 500000).alias("p"), cls.alias("cls"), (cls == 1).alias("palm"))

    def ms(self) -> DataFrame:
        """row, col, band (from 0), value: eight bands from embeddings on a grid 20 wide."""
        e = self.table("embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("band", "x"))
        dn = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("x").cast("double") + 0.6) * 200)))
        return e.select(F.floor(F.col("vec_id") / 20).cast("int").alias("row"), (F.col("vec_id") % 20).cast("int").alias("col"), "band", dn.cast("double").alias("value"))

    def crown(self) -> DataFrame:
        """id, box x0..y1, score: parts as boxes on a grid 50 wide."""
        p = self.table("part")
        x, y = (F.col("p_partkey") % 50).cast("double"), F.floor(F.col("p_partkey") / 50).cast("double")
        side = 0.4 + F.col("p_size") / 25
        return p.select(F.col("p_partkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + side).alias("x1"), (y + side).alias("y1"), F.col("p_retailprice").alias("score"), F.col("p_brand").alias("class_name"))

    def region(self) -> DataFrame:
        """region_id, split, box: five stripes ten wide."""
        r = self.table("region")
        k = F.col("r_regionkey")
        split = F.when(k % 3 == 0, "train").when(k % 3 == 1, " Val ").otherwise("TEST")
        return r.select(k.alias("region_id"), split.alias("split"), (k * 10.0).alias("x0"), F.lit(0.0).alias("y0"), (k * 10.0 + 10).alias("x1"), F.lit(40.0).alias("y1"))

    def files(self) -> DataFrame:
        """file, status, tree_count, error: events."""
        failed = F.col("event_type") == "error"
        return self.table("events").select(F.col("event_id").cast("string").alias("file"), F.when(failed, "failed").otherwise("ok").alias("status"), F.when(~failed, F.floor("value")).alias("tree_count"), F.when(failed, F.col("event_type")).alias("error"))

    def names(self) -> DataFrame:
        """File names of rasters and other files, from event ids; some repeat."""
        k = F.col("event_id")
        ext = F.when(k % 5 == 0, ".tif").when(k % 5 == 1, ".TIFF").when(k % 5 == 2, ".png").when(k % 5 == 3, ".tiff").otherwise(".txt")
        kind = F.when(k % 2 == 0, "_label").otherwise("_prob")
        return self.table("events").select(F.concat(F.lit("d/scene"), (k % 500).cast("string"), kind, ext).alias("name"))

    def classes(self) -> DataFrame:
        """class_name, cls: brands numbered from 1 in order; every sixth is unknown."""
        from pyspark.sql import Window

        b = self.table("part").select(F.col("p_brand").alias("class_name")).distinct()
        return b.withColumn("cls", F.row_number().over(Window.orderBy("class_name")).cast("int")).filter("cls % 6 <> 0")


#: The same views for the oracle.
SQL = {
    "px": """px AS (SELECT 's' AS scene, CAST(o_orderkey // 50 AS INT) AS row, CAST(o_orderkey % 50 AS INT) AS col, o_totalprice / 500000 AS p,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS cls, o_orderstatus = 'O' AS palm FROM orders)""",
    "ms": """ms AS (SELECT CAST(vec_id // 20 AS INT) AS row, CAST(vec_id % 20 AS INT) AS col, CAST(b AS INT) AS band,
  least(255, greatest(0, floor((CAST(embedding[b + 1] AS DOUBLE) + 0.6::DOUBLE) * 200))) AS value FROM embeddings, range(8) r(b))""",
    "crown": """crown AS (SELECT p_partkey AS id, CAST(p_partkey % 50 AS DOUBLE) AS x0, CAST(p_partkey // 50 AS DOUBLE) AS y0, CAST(p_partkey % 50 AS DOUBLE) + (0.4::DOUBLE + p_size / 25::DOUBLE) AS x1,
  CAST(p_partkey // 50 AS DOUBLE) + (0.4::DOUBLE + p_size / 25::DOUBLE) AS y1, p_retailprice AS score, p_brand AS class_name FROM part)""",
    "region": """reg AS (SELECT r_regionkey AS region_id, CASE r_regionkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN ' Val ' ELSE 'TEST' END AS split,
  r_regionkey * 10.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, r_regionkey * 10.0::DOUBLE + 10 AS x1, 40.0::DOUBLE AS y1 FROM region)""",
    "files": """files AS (SELECT CAST(event_id AS VARCHAR) AS file, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS tree_count, CASE WHEN event_type = 'error' THEN event_type END AS error FROM events)""",
    "names": """names AS (SELECT 'd/scene' || (event_id % 500) || CASE event_id % 2 WHEN 0 THEN '_label' ELSE '_prob' END
  || CASE event_id % 5 WHEN 0 THEN '.tif' WHEN 1 THEN '.TIFF' WHEN 2 THEN '.png' WHEN 3 THEN '.tiff' ELSE '.txt' END AS name FROM events)""",
    "classes": """classes AS (SELECT * FROM (SELECT class_name, CAST(row_number() OVER (ORDER BY class_name) AS INT) AS cls FROM (SELECT DISTINCT p_brand AS class_name FROM part)) WHERE cls % 6 <> 0)""",
}


def with_views(names: str, body: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
