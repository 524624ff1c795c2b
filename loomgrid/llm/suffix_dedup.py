"""Repeated substrings of LENGTH bytes, found through suffix arrays of content-aligned blocks.

1. Every LENGTH-byte window is owned by the least 20-byte gram in it (the leftmost of equals), so
   equal windows have equal owners at equal offsets. A "twice" filter drops owners met once.
2. The windows that one occurrence of a gram owns lie in one span. Equal spans are folded by a 64-bit hash before any span is
   compared, so a copy that a third of all rows share is handled once.
3. Where a gram has different spans, their bytes meet in one task. From the gram to the right, and
   from it to the left, each span is a string of BLOCK-byte blocks. The suffix array of
   all these strings (suffix_array.py) puts them in the order of their bytes; the common prefixes of
   neighbours, counted byte by byte, tell which spans agree on so many bytes to the right and which on so many to the left. A window that reaches a
   bytes to the left of its gram is repeated if another span is with it in both classes. Nothing else decides.
4. A gram with very many spans is dealt out by more of their bytes: the windows that reach far to the left share at
   least those bytes, the others those to the right; the halves are halved again as long as needed.

A suffix array over single bytes costs about 6 microseconds a byte in Python; over blocks it is
read for every span and costs a twentieth of that, and orders the same bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import documents, lookup, slices, small_batches, table, with_texts
from loomgrid.llm.line_dedup import filter_bits, is_twice, twice_filter
from loomgrid.llm.neardup import by_group
from loomgrid.llm.suffix_array import suffix_array
from loomgrid.llm.words import FACTOR, INVERSE, mix, powers

LENGTH, GRAM, BLOCK = 200, 20, 20
#: Spans with one key that one task compares; beyond it the key takes in more bytes.
TOGETHER = 10_000
#: The most bytes of a window that lie left of its gram.
REACH = LENGTH - GRAM
#: Spans resolved at once within a task.
CHUNK = 2000
PLACE_BITS = np.uint64(28)
#: Bytes of a text whose owners are found at once; longer texts are taken in pieces.
PIECE = 2 << 20


class Hashed:
    """Bytes with prefix sums from which any substring's 64-bit hash follows."""

    def __init__(self, data: np.ndarray) -> None:
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(FACTOR, len(data)), out=self.total[1:])
        self.back = powers(INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(np.uint64))


def owners(raws: list[bytes], piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """Owned runs of windows: text number, gram hash, span hash, first and last window, and the gram's place (in the text).

    A long text is cut into pieces that share no window; a run that such a cut parts is two.
    """
    pieces = [(t, i, raw[i : i + piece + LENGTH - 1]) for t, raw in enumerate(raws) for i in range(0, max(len(raw) - LENGTH + 1, 1), piece)]
    found, held, size = [], [], 0
    for x in [*pieces, None]:
        if held and (x is None or size + len(x[2]) > 2 * piece):
            t, gram, span, first, last, place = _owners([h[2] for h in held])
            text, begin = (np.array([h[k] for h in held], np.int64)[t] for k in (0, 1))
            found.append((text, gram, span, first + begin, last + begin, place + begin))
            held, size = [], 0
        if x:
            held.append(x)
            size += len(x[2])
    if not found:
        return _owners([])
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _owners(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """As ``owners``, for texts that fit PLACE_BITS together."""
    lengths = np.fromiter(map(len, raws), np.int64, len(raws))
    begins = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(raws), np.uint8)
    n = len(data) - GRAM + 1
    wide = LENGTH - GRAM + 1
    if n < wide:
        return tuple(np.zeros(0, k) for k in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    hashed = Hashed(data)
    at = np.arange(n)
    gram = hashed.of(at, at + GRAM)
    key = (gram >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64)
    padded = np.full(-(-n // wide) * wide, np.iinfo(np.uint64).max)
    padded[:n] = key
    rows = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n_windows = n - wide + 1
    least = np.minimum(behind[:n_windows], ahead[wide - 1 : wide - 1 + n_windows])
    owner = (least & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    # Windows must not cross texts.
    text = np.repeat(np.arange(len(raws)), lengths)[:n_windows]
    inside = np.arange(n_windows) + LENGTH <= (begins + lengths)[text]
    change = np.ones(n_windows, bool)
    change[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    last = np.r_[first[1:], n_windows] - 1
    ok = inside[first]
    first, last = first[ok], last[ok]
    p, t = owner[first], text[first]
    span = mix(hashed.of(first, last + LENGTH) + ((p - first) * 1000 + last - first).astype(np.uint64))
    return t, gram[p], span, first - begins[t], last - begins[t], p - begins[t]


def _owner_keys(text: pa.Array) -> np.ndarray:
    """Gram hashes of all owned runs, as two words each, for the "twice" filter."""
    gram = owners(pc_raws(text))[1]
    return np.column_stack([gram, mix(gram)]).view(np.int64)


def pc_raws(text: pa.Array) -> list[bytes]:
    return text.cast(pa.binary()).to_pylist()


RUN = "doc_id long, row_key long, k long, fold long, first int, last int, place int"


def _runs(bits, n_bits: int) -> Callable:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(bits.value, np.uint8)
        for b in slices(batches, 1):
            t, gram, span, first, last, place = owners(pc_raws(b.column(1)))
            hit = is_twice(np.column_stack([gram, mix(gram)]).view(np.int64), twice, n_bits)
            t = pa.array(t[hit])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(t), b.column(2).take(t), *(pa.array(x[hit].view(np.int64)) for x in (gram, span)), *(pa.array(x[hit].astype(np.int32)) for x in (first, last, place))],
                names=["doc_id", "row_key", "k", "fold", "first", "last", "place"],
            )

    return task


SPAN = "k long, fold long, n long, doc_id long, row_key long, first int, place int, span binary, low int, high int"
NAMES = ["k", "fold", "n", "doc_id", "row_key", "first", "place", "span", "low", "high"]


def _spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, row_key, text, open): the bytes of each open span, and the reach of the windows asked for (all)."""
    kinds = [*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
    for b in slices(batches, 2):
        rows = []
        for doc_id, row_key, raw, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc_raws(b.column(2)), b.column(3).to_pylist(), strict=True):
            rows += [(s["k"], s["fold"], s["n"], doc_id, row_key, s["first"], s["place"], raw[s["first"] : s["last"] + LENGTH], 0, REACH) for s in spans]
        columns = zip(*rows, strict=True) if rows else [()] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)


def _halves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of SPAN twice, with half the reach; the key takes in all the bytes that windows of that reach share."""
    for b in batches:
        out: dict[str, list] = {name: [] for name in NAMES}
        for row in b.to_pylist():
            place, span = row["place"] - row["first"], row["span"]
            middle = (row["low"] + row["high"]) // 2
            for low, high in ((row["low"], middle), (middle + 1, row["high"])):
                i, j = place - low, place + LENGTH - high
                if low <= high and i >= 0 and j <= len(span):
                    digest = hashlib.blake2b(span[i:j], digest_size=8, key=f"{row['k']},{low},{high}".encode()).digest()
                    for name, value in (row | {"k": int.from_bytes(digest, "little", signed=True), "low": low, "high": high}).items():
                        out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in b.schema], schema=b.schema)


def _ordered(group: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the spans by group and by their bytes from the gram on, and the bytes each has in common with the one before it.

    starts: the gram's first byte (sign 1: to the right), or the byte after the part to its left (sign -1: read to the left);
    sizes: bytes there are. The first of a group has -1 in common. The order is read off the suffix array of
    the strings (group, blocks, end); blocks are ranked by their bytes, a shorter last block first.
    """
    n = len(group)
    count = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(n), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(sizes[owner] - number * BLOCK, BLOCK)
    reach = number[:, None] * BLOCK + np.arange(BLOCK)
    at = starts[owner, None] + reach if sign > 0 else starts[owner, None] - 1 - reach
    used = np.arange(BLOCK) < length[:, None]
    blocks = np.where(used, data[np.where(used, at, 0)], 0).astype(np.uint8)
    whole = np.zeros((len(owner), 24), np.uint8)
    whole[:, :BLOCK], whole[:, BLOCK] = blocks, length
    words = whole.view(">u8").astype(np.uint64)
    sort = np.lexsort(words.T[::-1])
    new = np.ones(len(owner), bool)
    new[1:] = (words[sort[1:]] != words[sort[:-1]]).any(axis=1)
    rank = np.empty(len(owner), np.int64)
    rank[sort] = np.cumsum(new)
    groups, which = np.unique(group, return_inverse=True)
    # The group comes first, above all blocks, so that the spans' strings are one run of the array for each group.
    first = np.cumsum(count + 2) - (count + 2)
    flat = np.zeros(int((count + 2).sum()), np.int64)
    flat[first] = len(owner) + 1 + which
    flat[first[owner] + 1 + number] = rank
    string = np.full(len(flat), -1)
    string[first] = np.arange(n)
    order = string[suffix_array(flat)]
    order = order[order >= 0]
    a, b = order[:-1], order[1:]
    width = int(count.max(initial=0)) + 1
    table = np.zeros((n, width), np.int64)
    table[owner, number] = rank
    equal = np.minimum.accumulate((table[a] == table[b]) & (table[a] > 0), axis=1).sum(axis=1)
    begin = np.cumsum(count) - count
    more = (equal < count[a]) & (equal < count[b])  # the blocks that differ, byte by byte
    x, y = begin[a[more]] + equal[more], begin[b[more]] + equal[more]
    same = np.minimum.accumulate(blocks[x] == blocks[y], axis=1).sum(axis=1)
    common = np.minimum(equal * BLOCK, np.minimum(sizes[a], sizes[b]))
    common[more] += np.minimum(same, np.minimum(length[x], length[y]))
    common[group[a] != group[b]] = -1
    return order, np.r_[-1, common][:n]


def repeated_windows(group: np.ndarray, n: np.ndarray, place: np.ndarray, spans: list[bytes], low: np.ndarray | None = None, high: np.ndarray | None = None) -> list[np.ndarray]:
    """For each span, the windows (numbers from its first) that another span of its group has as well.

    place: of the gram in the span. Spans with n > 1 only serve the others. low, high: the least and most bytes left of the
    gram that windows asked for have (the same for a group).
    """
    sizes = np.fromiter(map(len, spans), np.int64, len(spans))
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(spans), np.uint8)
    m = len(spans)
    low, high = np.zeros(m, np.int64) if low is None else low, np.full(m, REACH) if high is None else high
    sides = []
    for starts, size, sign in ((begins + place, sizes - place, 1), (begins + place, place, -1)):
        order, common = _ordered(group, data, starts, size, sign)
        most = np.empty(m, np.int64)
        most[order] = np.maximum(common, np.r_[common[1:], -1])
        sides.append((order, common, most))
    (r_order, r_common, r_most), (l_order, l_common, l_most) = sides
    numbers = np.arange(m)
    owner, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    right, left = np.empty(m, np.int64), np.empty(m, np.int64)
    for reach in range(REACH + 1):
        able = (r_most >= LENGTH - reach) & (l_most >= reach) & (reach <= place) & (place - reach + LENGTH <= sizes) & (low <= reach) & (reach <= high)
        if able.sum() < 2:
            continue
        # Classes: runs of the order within which that many bytes are in common.
        right[r_order] = np.maximum.accumulate(np.where(r_common < LENGTH - reach, numbers, 0))
        left[l_order] = np.maximum.accumulate(np.where(l_common < reach, numbers, 0))
        who = np.flatnonzero(able)
        _, back, count = np.unique(right[who] * m + left[who], return_inverse=True, return_counts=True)
        hit = who[(count[back] > 1) & (n[who] == 1)]
        owner.append(hit)
        number.append(place[hit] - reach)
    owner, number = np.concatenate(owner), np.concatenate(number)
    sort = np.lexsort((number, owner))
    owner, number = owner[sort], number[sort]
    cuts = np.searchsorted(owner, np.arange(m + 1))
    return [number[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


RANGE = "doc_id long, row_key long, first int, last int"


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["doc_id", "row_key", "first", "last"])


def _resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SPAN sorted by k, fold: ranges of repeated windows of the spans that occur once."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for parts in by_group(batches, [0]):
        held += parts
        rows += sum(p.num_rows for p in parts)
        if rows >= CHUNK:
            yield _resolved(held)
            held, rows = [], 0
    if held:
        yield _resolved(held)


def _resolved(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(parts)
    k, n, first, place, low, high = (t.column(c).to_numpy() for c in ("k", "n", "first", "place", "low", "high"))
    found = repeated_windows(k, n, (place - first).astype(np.int64), t.column("span").to_pylist(), low, high)
    doc_id, row_key = t.column("doc_id").to_pylist(), t.column("row_key").to_pylist()
    out = []
    for x, windows in enumerate(found):
        if len(windows):
            cut = np.flatnonzero(np.diff(windows) > 1)
            out += [(doc_id[x], row_key[x], int(first[x] + i), int(first[x] + j)) for i, j in zip(windows[np.r_[0, cut + 1]], windows[np.r_[cut, len(windows) - 1]], strict=True)]
    return _ranges(out)


def _dealt(spans: DataFrame) -> list[DataFrame]:
    """Ranges of repeated windows of spans with very common keys: halved in reach until a task can compare those with one key."""
    out, width = [], REACH + 1
    while width > 1:
        width = -(-width // 2)
        spans = table(spans.mapInArrow(_halves, SPAN), "suffix-halves")
        met = spans.groupBy("k").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        spans = lookup(spans, met, ["k"], "m", spans.count())
        # At a reach of one byte a key stands for a whole window, which all its spans have.
        last = spans.filter(F.col("m") > TOGETHER)
        few = spans.filter(F.col("m") <= TOGETHER).select(*NAMES).repartition("k").sortWithinPartitions("k", "fold")
        out.append(table(few.mapInArrow(_resolve, RANGE), "suffix-ranges"))
        spans = table(last.select(*NAMES), "suffix-common")
        if not spans.limit(1).count():
            return out
    at = F.col("place") - F.col("low")
    out.append(spans.filter("n = 1").select("doc_id", "row_key", at.alias("first"), at.alias("last")))
    return out


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        out = []
        for raw, ranges in zip(pc_raws(b.column(1)), b.column(2).to_pylist(), strict=True):
            left, at, runs = [], 0, 0
            for r in sorted(ranges or (), key=lambda r: r["first"]):
                i, j = r["first"], r["last"] + LENGTH
                runs += i > at or not runs
                left.append(raw[at:i] if i > at else b"")
                at = max(at, j)
            kept = b"".join([*left, raw[at:]])
            out.append((kept, len(raw), len(raw) - len(kept), runs))
        columns = zip(*out, strict=True) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, [pa.binary(), *[pa.int64()] * 3], strict=True))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Remove every byte covered by a 200-byte string that also starts anywhere else, in any row of ``docs``.

    Returns per row: doc_id, kept (bytes left), n_bytes, n_removed, n_spans (maximal removed runs). Texts are
    UTF-8 bytes, null text is empty, matches stay within rows; strings are judged on the input. A row that repeats
    another, doc_id included, counts as a text of its own, so both lose what they share. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = documents(docs)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_bits = filter_bits(n_bytes // 90)
    bits = spark.sparkContext.broadcast(twice_filter(docs, n_bits, _owner_keys).tobytes())
    runs = table(docs.mapInArrow(_runs(bits, n_bits), RUN), "suffix-runs")

    one = F.min(F.struct("doc_id", "row_key", "first", "last", "place")).alias("one")
    folds = table(runs.groupBy("k", "fold").agg(F.count(F.lit(1)).alias("n"), one), "suffix-folds")
    grams = folds.groupBy("k").agg(F.count(F.lit(1)).alias("folds"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single")).filter("folds > 1 and single > 0")
    grams = table(grams.select("k", "folds"), "suffix-grams")
    n_runs = folds.agg(F.sum("n")).first()[0] or 0

    # Spans met twice: all their windows, in all their occurrences.
    twice = lookup(runs.select("doc_id", "row_key", "k", "fold", "first", "last"), folds.filter("n > 1").select("k", "fold", "n"), ["k", "fold"], "n", n_runs)
    whole = twice.select("doc_id", "row_key", "first", "last")

    # Spans of grams with several: one occurrence of each gives the bytes.
    total = grams.agg(F.sum("folds")).first()[0] or 0
    asked = lookup(folds.select("k", "fold", "n", "one.*"), grams, ["k"], "folds", total)
    per_row = asked.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("k", "fold", "n", "first", "last", "place", "folds")).alias("open"))
    texts = with_texts(docs.dropDuplicates(["doc_id", "row_key"]), per_row).filter("open is not null")
    close = F.filter("open", lambda s: s["folds"] <= TOGETHER).alias("open")
    common = F.filter("open", lambda s: s["folds"] > TOGETHER).alias("open")
    near = texts.select("doc_id", "row_key", "text", close).mapInArrow(_spans, SPAN).repartition("k").sortWithinPartitions("k", "fold")
    parts = [table(near.mapInArrow(_resolve, RANGE), "suffix-ranges")]
    if grams.filter(F.col("folds") > TOGETHER).limit(1).count():
        parts += _dealt(table(texts.select("doc_id", "row_key", "text", common).filter(F.size("open") > 0).mapInArrow(_spans, SPAN), "suffix-common"))
    ranges = whole
    for p in parts:
        ranges = ranges.unionAll(p)
    per_text = ranges.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return with_texts(docs, per_text).select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
