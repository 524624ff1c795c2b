"""Repeated lines through two Bloom filters, then exact confirmation of suspects.

Map tasks set the bits of every distinct line key of a document in a "seen once"
filter, and in "seen twice" where the bits were already set. The tasks' filters
meet shard by shard (a shard is a range of bits): a bit that two tasks set is
a "twice" bit. Only keys whose bits are all in "twice" are shuffled, and
grouped exactly. A key in two documents sets its bits twice, so none is missed;
false suspects cost shuffle and nothing else. The "twice" filter is broadcast: it is
sized by the number of lines up to MAX_BITS, which bounds it at 32 MB; beyond
that more keys are suspected and the result stays the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import documents, lookup, slices, small_batches, table, with_texts

#: Fixed value: the white space stripped from both ends of a line.
SPACE = " \t\n\x0b\x0c\r"
MIN_POINTS = 20
MIN_DOCUMENTS = 3
MAX_BITS = 1 << 28
SHARD_BITS = 1 << 20
BITS_PER_LINE = 12


def line_keys(text: pa.Array, min_points: int = MIN_POINTS) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All lines, the number of the text each is in, which are long enough, and the 16-byte keys of those as two words each."""
    lists = pc.split_pattern(text, "\n")
    lines, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    keys = pc.ascii_lower(pc.utf8_trim(lines, SPACE))
    long = pc.greater_equal(pc.utf8_length(keys), min_points).to_numpy(zero_copy_only=False)
    digest = xxhash.xxh3_128_digest
    joined = b"".join(digest(x) for x in keys.filter(pa.array(long)).cast(pa.binary()).to_pylist())
    return lines, parent, long, np.frombuffer(joined, "<i8").reshape(-1, 2)


def distinct_keys(text: pa.Array, min_points: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and key of each distinct long key of each text."""
    _, parent, long, keys = line_keys(text, min_points)
    if not len(keys):
        return parent[:0], keys
    found = np.unique(np.column_stack([parent[long].astype(np.int64), keys]), axis=0)
    return found[:, 0], found[:, 1:]


def _bits(keys: np.ndarray, n_bits: int) -> np.ndarray:
    """Two bit positions for each key."""
    words = keys.view(np.uint64)
    return np.column_stack([words[:, 0] & np.uint64(n_bits - 1), words[:, 1] & np.uint64(n_bits - 1)]).astype(np.int64)


def _seen(n_bits: int, keys_of: Callable) -> Callable:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[np.ndarray] = []
        for b in slices(batches, 0):
            keys = keys_of(b.column(0))
            counts.append(np.sort(_bits(keys, n_bits), axis=1).ravel())
        if not counts:
            return
        once, n = np.unique(np.concatenate(counts), return_counts=True)
        shard, at = once // SHARD_BITS, (once % SHARD_BITS).astype(np.uint32)
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
        for i, j in zip(starts, [*starts[1:], len(shard)], strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(shard[i])], pa.int64()), pa.array([at[i:j].tobytes()]), pa.array([at[i:j][n[i:j] > 1].tobytes()])], names=["shard", "once", "twice"]
            )

    return task


SEEN = "shard long, once binary, twice binary"


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    """Once and twice positions of one shard: what two tasks have once is there twice."""
    n = np.zeros(SHARD_BITS, np.uint8)
    for once, twice in zip(part["once"], part["twice"], strict=True):
        at = np.frombuffer(once, np.uint32)
        n[at] = np.minimum(n[at] + 1, 2)
        n[np.frombuffer(twice, np.uint32)] = 2
    at = np.flatnonzero(n).astype(np.uint32)
    return pd.DataFrame({"shard": [part["shard"].iloc[0]], "once": [at.tobytes()], "twice": [np.flatnonzero(n == 2).astype(np.uint32).tobytes()]})


def _packed(part: pd.DataFrame) -> pd.DataFrame:
    """The merged "twice" bits of one shard, packed."""
    bits = np.zeros(SHARD_BITS, bool)
    bits[np.frombuffer(_merge(part)["twice"][0], np.uint32)] = True
    return pd.DataFrame({"shard": [part["shard"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def filter_bits(n_keys: int) -> int:
    """A power of two, by the number of keys, at most MAX_BITS."""
    return min(MAX_BITS, max(SHARD_BITS, 1 << (BITS_PER_LINE * n_keys).bit_length()))


def is_twice(keys: np.ndarray, twice: np.ndarray, n_bits: int) -> np.ndarray:
    """Which keys have all their bits in the packed "twice" filter."""
    at = _bits(keys, n_bits)
    return ((twice[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def twice_filter(docs: DataFrame, n_bits: int, keys_of: Callable) -> np.ndarray:
    """The packed bits of the "twice" filter over the keys (two words each) that ``keys_of`` finds in an array of texts."""
    seen = docs.select("text").mapInArrow(_seen(n_bits, keys_of), SEEN)
    salted = seen.withColumn("salt", F.spark_partition_id() % 16)
    some = salted.groupBy("shard", "salt").applyInPandas(_merge, SEEN)
    bits = np.zeros(n_bits // 8, np.uint8)
    for shard, packed in some.groupBy("shard").applyInPandas(_packed, "shard long, bits binary").toLocalIterator():
        bits[shard * SHARD_BITS // 8 : (shard + 1) * SHARD_BITS // 8] = np.frombuffer(packed, np.uint8)
    return bits


def _suspects(bits, n_bits: int, min_points: int) -> Callable:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(bits.value, np.uint8)
        for b in slices(batches, 1):
            parent, keys = distinct_keys(b.column(1), min_points)
            hit = is_twice(keys, twice, n_bits)
            parent, keys = parent[hit], keys[hit]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(parent)), b.column(2).take(pa.array(parent)), pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["doc_id", "row_key", "k1", "k2"])

    return task


def _drop(min_points: int) -> Callable:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            lines, parent, long, keys = line_keys(b.column(1), min_points)
            dropped = [{(x["k1"], x["k2"]) for x in d} if d else () for d in b.column(3).to_pylist()]
            gone = np.zeros(len(lines), bool)
            gone[long] = [(k1, k2) in dropped[p] if dropped[p] else False for p, k1, k2 in zip(parent[long].tolist(), *keys.T.tolist(), strict=True)]
            n = np.bincount(parent, minlength=b.num_rows)
            n_gone = np.bincount(parent[gone], minlength=b.num_rows)
            kept = lines.filter(pa.array(~gone))
            ends = np.cumsum(n - n_gone)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), kept), "\n")
            yield pa.RecordBatch.from_arrays([b.column(0), texts, pa.array(n, pa.int64()), pa.array(n_gone, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return task


def line_dedup(docs: DataFrame, min_points: int = MIN_POINTS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Drop lines repeated across documents; returns doc_id, text (kept lines), n_lines, n_dropped per row.

    A line's key is the line stripped of white space at both ends, A-Z
    lower-cased. Keys of at least ``min_points`` code points in at least
    ``min_documents`` documents (at least 2) lose all lines but those in the
    largest doc_id that holds them. Null or empty text is one empty line. Rows that share a doc_id
    count as one document; a null doc_id counts as a document below all others.
    An empty table gives an empty result. Keys are compared by 128-bit hashes.
    """
    if min_documents < 2:
        raise ValueError("min_documents must be at least 2")
    spark = docs.sparkSession
    small_batches(spark)
    docs = documents(docs)
    n_lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    n_bits = filter_bits(n_lines)
    bits = spark.sparkContext.broadcast(twice_filter(docs, n_bits, lambda text: distinct_keys(text, min_points)[1]).tobytes())
    suspects = table(docs.mapInArrow(_suspects(bits, n_bits, min_points), "doc_id long, row_key long, k1 long, k2 long"), "line-suspects")
    number = F.coalesce("doc_id", F.lit(-(2**63)))
    found = suspects.groupBy("k1", "k2").agg(F.count_distinct(number).alias("n"), F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("keep_id"))
    repeated = table(found.filter(F.col("n") >= min_documents).select("k1", "k2", "rows", "keep_id"), "line-repeats")
    total = suspects.count()
    hits = lookup(suspects, repeated, ["k1", "k2"], "rows", total).filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    drops = hits.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("k1", "k2")).alias("drops"))
    joined = with_texts(docs, drops).select("doc_id", "text", "row_key", "drops")
    return joined.mapInArrow(_drop(min_points), "doc_id long, text string, n_lines long, n_dropped long")


def sha256_hex(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the column ``text`` by kept_sha256."""
    for b in batches:
        digests = [hashlib.sha256(x).hexdigest() for x in b.column("text").cast(pa.binary()).to_pylist()]
        at = b.schema.get_field_index("text")
        yield b.set_column(at, "kept_sha256", pa.array(digests))
