"""Exact duplicates through cuckoo-filter indexes over sharded digests.

Every text is reduced to the SHA-256 of its normalised bytes. Map tasks first
fold equal digests into one partial entry, so a digest that a third of all rows
share leaves each task once. Shards of the digest space, as many as keep each below about SHARD rows, then keep a
:class:`CuckooIndex`: a probe of the 16-bit fingerprints says "surely new", and the digest is stored unseen, or
"perhaps known"; only then the full digests are asked. An insertion that finds no room makes the filter twice as large and
refills it from the stored digests.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import documents, lookup, slices, small_batches, table, tidy

#: Fixed value: the white space that normalisation deletes.
SPACE = b" \t\n\x0b\x0c\r"
SLOTS = 4
MAX_KICKS = 200
#: Rows of a shard, and live digests after which a map task hands on what it has.
SHARD = 1_000_000


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, SPACE)


class CuckooIndex:
    """Set of live digests with a cuckoo filter in front of bucketed exact content.

    ``insert`` and ``delete`` keep filter and content in step; ``find`` returns
    the value stored for a digest or None. A fingerprint hit without the digest
    in the content is counted in ``false_hits``.
    """

    def __init__(self, buckets: int = 1024) -> None:
        self.n = 1 << max(2, (buckets - 1).bit_length())
        self.slots = array("H", bytes(2 * SLOTS * self.n))
        self.content: dict[bytes, object] = {}
        self.false_hits = 0
        self.resizes = 0

    def __len__(self) -> int:
        return len(self.content)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[8:16], "little") & (self.n - 1)
        return mark, first, self._other(first, mark)

    def _other(self, at: int, mark: int) -> int:
        return (at ^ (mark * 0x5BD1E995)) & (self.n - 1)

    def _swap(self, at: int, old: int, new: int) -> bool:
        """Put ``new`` in a slot of bucket ``at`` that holds ``old``."""
        row = self.slots[at * SLOTS : at * SLOTS + SLOTS]
        if old not in row:
            return False
        self.slots[at * SLOTS + row.index(old)] = new
        return True

    def find(self, digest: bytes):
        mark, a, b = self._places(digest)
        if mark not in self.slots[a * SLOTS : a * SLOTS + SLOTS] and mark not in self.slots[b * SLOTS : b * SLOTS + SLOTS]:
            return None
        value = self.content.get(digest)
        self.false_hits += value is None
        return value

    def insert(self, digest: bytes, value, merge: Callable | None = None) -> None:
        """Add a live digest. One that is already there gets ``value``, or merge(old, value)."""
        mark, a, b = self._places(digest)
        if mark in self.slots[a * SLOTS : a * SLOTS + SLOTS] or mark in self.slots[b * SLOTS : b * SLOTS + SLOTS]:
            known = self.content.get(digest)
            if known is not None:
                self.content[digest] = merge(known, value) if merge else value
                return
            self.false_hits += 1
        self.content[digest] = value
        if not self._place(digest):
            self._grow()

    def _place(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        if self._swap(a, 0, mark) or self._swap(b, 0, mark):
            return True
        at = a
        for kick in range(MAX_KICKS):
            slot = at * SLOTS + (kick + mark) % SLOTS
            mark, self.slots[slot] = self.slots[slot], mark
            at = self._other(at, mark)
            if self._swap(at, 0, mark):
                return True
        return False

    def _grow(self) -> None:
        while True:
            self.n *= 2
            self.resizes += 1
            self.slots = array("H", bytes(2 * SLOTS * self.n))
            if all(self._place(d) for d in self.content):
                return

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False when it isn't stored (the filter stays as it is)."""
        if digest not in self.content:
            return False
        mark, a, b = self._places(digest)
        if not self._swap(a, mark, 0):
            self._swap(b, mark, 0)
        del self.content[digest]
        return True


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        digests = [hashlib.sha256(x.translate(None, SPACE)).digest() for x in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pc.cast(pc.utf8_length(b.column(1)), pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "row_key", "n_points", "digest"]
        )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (hash of the text), n_points (code points of the original text), digest (32 bytes); null text counts as empty."""
    small_batches(docs.sparkSession)
    return documents(docs).mapInArrow(tidy(_digests), "doc_id long, row_key long, n_points long, digest binary")


def _better(a: tuple, b: tuple) -> tuple:
    """Entries are (n_points, doc_id or None, row_key, size); longest text, then smallest id (a null id last), then least key."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    return (*min(a, b, key=rank)[:3], a[3] + b[3])


def _live(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    live = list(index.content.items())
    for k in range(0, len(live), 10_000):
        part = live[k : k + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in part], pa.binary()), *(pa.array([e[i] for _, e in part], pa.int64()) for i in range(4))],
            names=["digest", "n_points", "keep_id", "keep_key", "group_size"],
        )


def _fold(most: int | None = None) -> Callable:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge partial entries in a cuckoo index and return the live ones, as soon as there are ``most`` where that is given."""
        index = CuckooIndex()
        for b in batches:
            for digest, *entry in zip(*(c.to_pylist() for c in b.columns), strict=True):
                index.insert(digest, tuple(entry), _better)
            if most and len(index) >= most:
                yield from _live(index)
                index = CuckooIndex()
        yield from _live(index)

    return task


ENTRY = "digest binary, n_points long, keep_id long, keep_key long, group_size long"


def _partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial entries of a map task; one worker takes the digests and folds them, so that a task has no second one."""
    rows = (pa.RecordBatch.from_arrays([b.column(3), b.column(2), b.column(0), b.column(1), pa.repeat(pa.scalar(1, pa.int64()), b.num_rows)], names=["digest", "n_points", "doc_id", "row_key", "size"]) for b in _digests(batches))
    yield from _fold(SHARD)(rows)


def groups(docs: DataFrame, n_rows: int) -> DataFrame:
    """One row per distinct digest of ``docs``: digest, n_points, keep_id, keep_key, group_size.

    Indexed twice: within each map task, so that a digest leaves it once however
    many rows share it, and within each shard of the digest space. Where Spark's own number of partitions makes shards small enough,
    Spark may join small ones.
    """
    small_batches(docs.sparkSession)
    entries = documents(docs).mapInArrow(tidy(_partial), ENTRY)
    shards = -(-n_rows // SHARD)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(F.col("digest")) if shards <= least else entries.repartition(shards, F.col("digest"))
    return dealt.mapInArrow(tidy(_fold()), ENTRY)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Mark exact duplicates of ``docs`` (doc_id, text, further columns ignored).

    Texts are equal when identical after deleting space and the characters 9 to
    13. Returns, for every input row, doc_id, keep_id, group_size, kept,
    text_sha256. The row with the most code points stays, then the smallest
    doc_id, a null doc_id last. Null text counts as empty; rows repeated with one
    doc_id count one by one in group_size and are all marked alike. An empty
    table gives an empty result.
    """
    n_rows = docs.count()
    found = table(groups(docs, n_rows), "exact-groups")
    out = lookup(digests(docs).select("doc_id", "digest"), found.select("digest", "keep_id", "group_size"), ["digest"], "group_size", n_rows)
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts (see exact_dedup), with all its columns; null texts and empty ones are one group.

    Of rows that share a doc_id too the one with the longest text stays, and of repeated rows any one. An empty table stays empty.
    """
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    keep = groups(docs, docs.count()).select(number("keep_id").alias("_lg_id"), F.col("keep_key").alias("_lg_key"))
    rows = docs.withColumns({"_lg_id": number("doc_id"), "_lg_key": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    return rows.join(keep, ["_lg_id", "_lg_key"], "left_semi").dropDuplicates(["_lg_id", "_lg_key"]).drop("_lg_id", "_lg_key")
