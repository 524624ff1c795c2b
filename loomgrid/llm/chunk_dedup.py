"""Repeated substrings by content-defined chunking with a gear rolling hash.

A byte ends a chunk when the top bits of the gear hash over the last 32 bytes are
zero (and the chunk has MIN_CHUNK bytes), or at MAX_CHUNK bytes. The cut points
depend on content, so an insertion moves only the cuts near it. Chunks are
compared by 128-bit digests; an occurrence after the first is a duplicate and is
removed. ``min_run`` leaves runs of duplicates below that many bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import documents, lookup, slices, small_batches, table, with_texts

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 32, 512, 5


def _gear() -> np.ndarray:
    """256 words by the splitmix64 rule, upper halves."""
    z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[data[i]] modulo 2**32 for all i, by doubling windows."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        if len(h) > shift:
            h[shift:] += h[:-shift] << np.uint32(shift)
    return h


def cut_points(data: np.ndarray, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK, mask_bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks, the last at len(data); none for no bytes."""
    n = len(data)
    wanted = (np.flatnonzero(gear_hashes(data) >> np.uint32(32 - mask_bits) == 0) + 1).tolist()
    ends, start = [], 0
    for end in wanted:
        while end - start > max_chunk:
            start += max_chunk
            ends.append(start)
        if end - start >= min_chunk:
            ends.append(end)
            start = end
    while n - start > max_chunk:
        start += max_chunk
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks(raw: bytes) -> tuple[list[int], np.ndarray]:
    """Ends of the chunks of a text and their digests, two words each."""
    ends = cut_points(np.frombuffer(raw, np.uint8))
    digest = xxhash.xxh3_128_digest
    joined = b"".join([digest(raw[i:j]) for i, j in zip([0, *ends], ends, strict=False)])
    return ends, np.frombuffer(joined, "<i8").reshape(-1, 2)


def _chunk_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        found = [chunks(x)[1] for x in b.column(1).cast(pa.binary()).to_pylist()]
        n = [len(x) for x in found]
        parent = pa.array(np.repeat(np.arange(len(n)), n))
        words = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        place = np.concatenate([np.arange(k) for k in n]) if n else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0).take(parent), b.column(2).take(parent), pa.array(place, pa.int32()), pa.array(words[:, 0]), pa.array(words[:, 1])], names=["doc_id", "row_key", "place", "k1", "k2"])


CHUNK = "doc_id long, row_key long, place int, k1 long, k2 long"


def _remove(min_run: int) -> Callable:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            out = []
            for raw, places in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                ends = cut_points(np.frombuffer(raw, np.uint8))
                out.append((*_without(raw, [0, *ends], sorted(places or ()), min_run), len(raw), len(ends), len(places or ())))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.binary(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "kept", "n_removed", "n_spans", "n_bytes", "n_chunks", "n_duplicates"])

    return task


def _without(raw: bytes, edges: list[int], places: list[int], min_run: int) -> tuple[bytes, int, int]:
    """Bytes left, bytes removed, and number of runs removed."""
    runs: list[list[int]] = []
    for p in places:
        if runs and runs[-1][1] == edges[p]:
            runs[-1][1] = edges[p + 1]
        else:
            runs.append([edges[p], edges[p + 1]])
    runs = [r for r in runs if r[1] - r[0] >= min_run]
    left, at = [], 0
    for i, j in runs:
        left.append(raw[at:i])
        at = j
    return b"".join([*left, raw[at:]]), sum(j - i for i, j in runs), len(runs)


def chunk_dedup(docs: DataFrame, min_run: int = 0) -> DataFrame:
    """Remove chunks seen before, in runs of at least ``min_run`` bytes.

    Returns per row of ``docs``: doc_id, kept (bytes left), n_removed, n_spans,
    n_bytes, n_chunks, n_duplicates. Of equal chunks the first by (doc_id, place
    in the text) stays; a null doc_id comes first. Null and empty texts have no
    chunks. Rows that repeat both doc_id and text count as one row and get the same answer. An
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = documents(docs)
    rows = docs.mapInArrow(_chunk_rows, CHUNK)
    first = F.min(F.struct("doc_id", "row_key", "place")).alias("first")
    found = rows.groupBy("k1", "k2").agg(first, F.count(F.lit(1)).alias("n"))
    repeated = table(found.filter("n > 1").select("k1", "k2", "n", F.col("first.doc_id").alias("d"), F.col("first.row_key").alias("r"), F.col("first.place").alias("p")), "chunk-repeats")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    again = lookup(rows, repeated, ["k1", "k2"], "n", total).filter(~(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("r")) & (F.col("place") == F.col("p"))))
    places = again.groupBy("doc_id", "row_key").agg(F.collect_set("place").alias("places"))
    joined = with_texts(docs, places).select("doc_id", "text", "row_key", "places")
    return joined.mapInArrow(_remove(min_run), "doc_id long, kept binary, n_removed long, n_spans long, n_bytes long, n_chunks long, n_duplicates long")
