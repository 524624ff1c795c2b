"""Helpers shared by the corpus operators: scratch tables, skew-safe lookups, whole-text joins.

Scratch data goes to the folder named by ``spark.checkpoint.dir`` (shared by
driver and executors). A written table cuts lineage: when an executor is lost
only the stages after the table are run again.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys held by more than 1 / HOT_PARTS of the rows are looked up by broadcast;
#: there can be fewer than HOT_PARTS of them, whatever the input size.
HOT_PARTS = 1000
#: Bytes of an Arrow batch, and of the slices of it that are worked on at once.
BATCH_BYTES, SLICE_BYTES = 8 << 20, 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a temporary one in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loomgrid-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of whole documents by rows and by bytes; all operators ask for the same bounds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Hand memory that is free in this process, but still held by Arrow's pool or the C library, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(task: Callable) -> Callable:
    """``task`` for mapInArrow, which gives memory back at its end: a worker stays, idle or in the next task, and an executor has several."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose texts (or binaries) in ``column`` have ``most`` bytes, or of one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, most + (ends[i - 1] if i else 0), side="right")))
            yield b.slice(i, j - i)
            i = j


def documents(df: DataFrame) -> DataFrame:
    """doc_id, text (null text: empty), and ``row_key`` to tell rows apart that share a doc_id.

    Only these columns are read, so further columns, whatever their names, do
    not matter.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row_key", F.xxhash64("text"))


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], size: str, total: int, how: str = "inner", hint: str = "") -> DataFrame:
    """Join ``rows`` to ``found`` (one row per key, ``size`` = rows with that key) without a hot task.

    Keys with more than total / HOT_PARTS rows number fewer than HOT_PARTS, so
    that part of ``found`` is broadcast: its size has a fixed bound. All other keys
    go through a shuffle join in which no key can hold a large part of the rows.
    hint: the join strategy of that part, where it must be the same at every size.
    """
    bar = max(total // HOT_PARTS, 1000)
    hot = F.broadcast(found.filter(F.col(size) > bar))
    cold = found.filter(F.col(size) <= bar)
    cold = cold.hint(hint) if hint else cold
    head = rows.join(hot, keys, "inner")
    rest = rows.join(F.broadcast(found.filter(F.col(size) > bar).select(*keys)), keys, "left_anti")
    return head.unionByName(rest.join(cold, keys, how), allowMissingColumns=True)


def with_texts(docs: DataFrame, per_row: DataFrame) -> DataFrame:
    """Left join of per-row lists (doc_id, row_key, ...) to whole texts; null doc_ids meet each other."""
    other = per_row.withColumnRenamed("doc_id", "_id").withColumnRenamed("row_key", "_key")
    on = docs["doc_id"].eqNullSafe(other["_id"]) & (docs["row_key"] == other["_key"])
    return docs.join(other, on, "left").drop("_id", "_key")
