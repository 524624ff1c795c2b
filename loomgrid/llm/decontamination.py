"""Benchmark decontamination with suffix arrays over shards of the training words.

Every task turns its documents into shards of about SHARD words and builds a
suffix array over each: word ranks, three of them packed into one sort key, then prefix doubling of the
suffixes that still tie, until none do. All suffixes of
the benchmark texts are binary-searched in every shard at once, word by word to their ends; an
interval that stays open for a whole window gives its occurrences, and the depths at which a suffix of a document lies in an open interval
give the document's longest verbatim match and its place. Words are equal when their 64-bit hashes are.
The test suffixes are broadcast in blocks of at most BLOCK words, one pass over the training data for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import documents, slices, small_batches, table, tidy
from loomgrid.llm.words import ALNUM, Words

WINDOW = 13
SHARD = 600_000
BLOCK = 1_000_000
#: Ranks take 21 bits, so that three of them fit a sort key; SHARD stays far below.
BITS = 21


class Suffixes:
    """Suffix array of a sequence of word ranks; breaks between texts differ from each other and from all words."""

    def __init__(self, hashes: np.ndarray, text: np.ndarray) -> None:
        """hashes, text: word hashes of a shard and the number of the text each word is in."""
        n = len(hashes)
        self.words, ranks = np.unique(hashes, return_inverse=True)
        breaks = np.flatnonzero(text[1:] != text[:-1]) + 1 if n else np.zeros(0, np.int64)
        where = np.arange(n) + np.searchsorted(breaks, np.arange(n), side="right")
        self.n, self.least = n + len(breaks), len(breaks) + 1
        self.ranks = np.zeros(self.n + 3, np.int64)  # the end is 0, then breaks, then words
        self.ranks[breaks + np.arange(len(breaks))] = np.arange(1, self.least)
        self.ranks[where] = ranks + self.least
        self.word_at = np.full(self.n, -1)  # number of the word at a position
        self.word_at[where] = np.arange(n)
        r = self.ranks
        key = (r[: self.n] << (2 * BITS)) | (r[1 : self.n + 1] << BITS) | r[2 : self.n + 2]
        self.order = np.argsort(key, kind="stable")
        self._refine(key[self.order])

    def _refine(self, key: np.ndarray) -> None:
        n, order = self.n, self.order
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a suffix's rank: where its group starts
        rank = np.full(n + 1, -1, np.int64)
        rank[order] = head
        depth = 3
        while True:
            tied = np.ones(n, bool)
            tied[:-1] = head[1:] == head[:-1]
            tied[1:] |= tied[:-1]
            tied[-1:] = n > 1 and head[-1] == head[-2]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            suffix = order[at]
            second = rank[np.minimum(suffix + depth, n)] + 1
            move = np.argsort(head[at] * (n + 1) + second, kind="stable")
            suffix, second = suffix[move], second[move]
            order[at] = suffix
            group = head[at]  # groups keep their places
            fresh = np.ones(len(at), bool)
            fresh[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
            head[at] = np.maximum.accumulate(np.where(fresh, at, 0))
            rank[suffix] = head[at]
            depth *= 2
        self.order = order

    def find(self, tests: np.ndarray, starts: np.ndarray, lengths: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, ...]:
        """Search the suffixes tests[starts[i] : starts[i] + lengths[i]] (word hashes), all at once.

        Returns lo, hi of the suffixes that match ``want[i]`` words, and for each word of the shard how many words from it on
        are verbatim those of some test.
        """
        at = np.searchsorted(self.words, tests)
        known = at < len(self.words)
        known[known] = self.words[at[known]] == tests[known]
        ranks = np.where(known, at + self.least, -1)
        m = len(starts)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n)
        got_lo, got_hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
        reach = np.zeros(self.n, np.int64)
        live, d = np.arange(m), 0
        while len(live := live[lengths[live] > d]):
            w = ranks[starts[live] + d]
            a = self._bound(lo[live], hi[live], d, w)
            b = self._bound(a, hi[live], d, w + 1)
            b = np.where(w < 0, a, b)
            lo[live], hi[live] = a, b
            live, d = live[b > a], d + 1
            self._mark(reach, lo[live], hi[live], d)
            full = live[want[live] == d]
            got_lo[full], got_hi[full] = lo[full], hi[full]
        by_word = np.zeros(max(self.n - self.least + 1, 0), np.int64)
        place = self.word_at[self.order]
        by_word[place[place >= 0]] = reach[place >= 0]
        return got_lo, got_hi, by_word

    def _mark(self, reach: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int) -> None:
        """Set ``reach`` to d within the intervals, which are many and wide only while d is small."""
        width = hi - lo
        if width.sum() > self.n:
            opened = np.bincount(lo, minlength=self.n + 1) - np.bincount(hi, minlength=self.n + 1)
            reach[np.cumsum(opened)[:-1] > 0] = d
        elif len(lo):
            reach[np.repeat(lo - (np.cumsum(width) - width), width) + np.arange(width.sum())] = d

    def _bound(self, lo: np.ndarray, hi: np.ndarray, d: int, w: np.ndarray) -> np.ndarray:
        """First index in [lo, hi) whose suffix has a word >= w at depth d."""
        lo, hi = lo.copy(), hi.copy()
        while len(todo := np.flatnonzero(lo < hi)):
            mid = (lo[todo] + hi[todo]) // 2
            less = self.ranks[np.minimum(self.order[mid] + d, self.n)] < w[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
        return lo


class Tests:
    """Word hashes of a block of benchmark items, their suffixes, and what a full match of each means."""

    def __init__(self, ids: list, texts: list[str], window: int = WINDOW) -> None:
        words = Words([_raw(t) for t in texts], ALNUM)
        self.ids, self.hashes, self.window = ids, words.hashes, window
        left = np.cumsum(words.counts)[words.text] - np.arange(len(words.text)) if len(words.text) else np.zeros(0, np.int64)
        self.starts, self.lengths, self.item = np.arange(len(left)), left, words.text
        counts = words.counts[words.text]
        first = np.r_[True, words.text[1:] != words.text[:-1]] if len(left) else np.zeros(0, bool)
        # A window starts here if 13 words are left, or at the first word of a shorter item.
        self.want = np.where(left >= window, window, np.where(first & (counts < window), counts, -1))
        self.longest = int(max(words.counts.max(initial=0), window))


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


class ShardWords:
    """Words of the texts of ``batches``: how many each has, the text each is in, and hashes. Arrays of a number for each byte are made for one slice at a time."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        counts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for b in slices(batches, 1):
            words = Words([x.lower() for x in b.column(1).cast(pa.binary()).to_pylist()], ALNUM)
            counts.append(words.counts)
            hashes.append(words.hashes)
        self.counts, self.hashes = np.concatenate(counts), np.concatenate(hashes)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)


def shards(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[list[pa.RecordBatch], ShardWords]]:
    """Consecutive batches (doc_id, text, row_key) of about ``size`` words, with their words."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column(1).nbytes
        if n >= 6 * size:
            yield held, ShardWords(held)
            held, n = [], 0
    if held:
        yield held, ShardWords(held)


def _pieces(words: Words, most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of words of about ``most`` words that overlap by the longest test, so that no match is cut."""
    most = max(most, 2 * overlap)
    n, at = len(words.hashes), 0
    while at < n:
        end = min(n, at + most)
        yield at, end
        if end == n:
            return
        at = end - overlap


def _hits(tests, most: int) -> Callable:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tests = tests.value
        for held, words in shards(batches, most):
            n_texts = len(words.counts)
            hit = np.zeros(len(words.hashes) + 1, np.int64)
            pairs: list[np.ndarray] = []
            reach = np.zeros(len(words.hashes), np.int64)
            for i, j in _pieces(words, most, t.longest):
                s = Suffixes(words.hashes[i:j], words.text[i:j])
                lo, hi, matched = s.find(t.hashes, t.starts, t.lengths, t.want)
                np.maximum(reach[i:j], matched, out=reach[i:j])
                for x in np.flatnonzero(hi > lo).tolist():
                    at = s.word_at[s.order[lo[x] : hi[x]]] + i
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + t.want[x], -1)
                    pairs.append(np.unique(words.text[at]) * len(t.ids) + t.item[x])
            longest, place = _longest(reach, words)
            covered = np.cumsum(hit[:-1]) > 0
            n_hit = np.bincount(words.text[covered], minlength=n_texts)
            both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            items: list[list] = [[] for _ in range(n_texts)]
            for text, item in zip((both // max(1, len(t.ids))).tolist(), (both % max(1, len(t.ids))).tolist(), strict=True):
                items[text].append(t.ids[item])
            spans = _spans(covered, words)
            columns = [pa.chunked_array([b.column(k) for b in held]).combine_chunks() for k in (0, 2)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(longest), pa.array(place)],
                names=["doc_id", "row_key", "n_words", "n_hit", "items", "spans", "longest", "longest_at"],
            )

    return task


def _longest(reach: np.ndarray, words: ShardWords) -> tuple[np.ndarray, np.ndarray]:
    """Longest match of each text and the first word it starts at; 0 where there is none."""
    longest, place = np.zeros(len(words.counts), np.int64), np.zeros(len(words.counts), np.int64)
    some = np.flatnonzero(words.counts)
    first = (np.cumsum(words.counts) - words.counts)[some]
    if len(some):
        longest[some] = np.maximum.reduceat(reach, first)
        at = np.flatnonzero(reach == longest[words.text])
        text, lead = np.unique(words.text[at], return_index=True)
        place[text] = at[lead] - first
    return longest, np.where(longest > 0, place, 0)


def _spans(covered: np.ndarray, words: ShardWords) -> list[list[list[int]]]:
    """Runs of hit words of each text, as first word and word after the last."""
    out: list[list[list[int]]] = [[] for _ in words.counts]
    at = np.flatnonzero(covered)
    if len(at):
        first = np.cumsum(words.counts) - words.counts
        cut = np.r_[True, (at[1:] != at[:-1] + 1) | (words.text[at[1:]] != words.text[at[:-1]])]
        ends = np.r_[at[:-1][cut[1:]], at[-1]]
        for i, j in zip(at[cut].tolist(), ends.tolist(), strict=True):
            k = int(words.text[i])
            out[k].append([i - int(first[k]), j + 1 - int(first[k])])
    return out


HITS = "doc_id long, row_key long, n_words long, n_hit long, items array<string>, spans array<array<bigint>>, longest long, longest_at long"


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[str], list[str]]]:
    """Item ids (as strings) and texts, in blocks of about BLOCK words at most, read one by one."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids, texts, n = [], [], 0
    for r in rows.filter("item_id is not null").distinct().toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        n += len(r.text) // 2 + 1
        if n >= BLOCK:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids or n == 0:
        yield ids, texts


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Occurrences of benchmark windows in whole documents.

    Words are runs of digits, letters A-Z (as a-z) and non-ASCII characters. Returns per row of ``docs``:
    doc_id, row_key (hash of the text), n_words, n_hit (words inside an occurrence of a window), items
    (item_ids with occurring windows, sorted as strings), spans (runs of hit words), longest and longest_at (words of the longest verbatim
    match with any item, and where it first starts; 0 without one). A window is ``window`` consecutive
    words of an item; a shorter item is one window. Null and empty texts have no words; items
    without words or with a null id have no windows, and an empty benchmark hits nothing. Repeated rows are
    judged row by row; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = documents(docs)
    found = None
    for ids, texts in _blocks(benchmark):
        tests = spark.sparkContext.broadcast(Tests(ids, texts, window))
        part = docs.select("doc_id", "text", "row_key").mapInArrow(tidy(_hits(tests, SHARD)), HITS)
        found = part if found is None else _both(found, table(part, "leak-block"))
    return found.withColumn("items", F.array_sort(F.array_distinct("items")))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merge the findings of two benchmark blocks for each row."""
    rows = table(a, "leak-blocks").unionAll(b)
    return rows.groupBy("doc_id", "row_key", "n_words").applyInPandas(_merge_rows, HITS)


def _merge_rows(part: pd.DataFrame) -> pd.DataFrame:
    """Rows of one text from two blocks (identical rows twice): union of their spans and items."""
    half = len(part) // 2
    spans = sorted([list(x) for s in part["spans"] for x in s])
    joined: list[list[int]] = []
    for i, j in spans:
        if joined and i <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], j)
        else:
            joined.append([int(i), int(j)])
    best = part.sort_values(["longest", "longest_at"], ascending=[False, True]).iloc[0]
    row = {
        "doc_id": part["doc_id"].iloc[0],
        "row_key": part["row_key"].iloc[0],
        "n_words": part["n_words"].iloc[0],
        "n_hit": sum(j - i for i, j in joined),
        "items": sorted({x for s in part["items"] for x in s}),
        "spans": joined,
        "longest": best["longest"],
        "longest_at": best["longest_at"],
    }
    out = pd.DataFrame([row] * max(half, 1))
    return out.astype({"doc_id": "Int64"})


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """A document is affected when at least one word in twenty is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no window of ``benchmark``, however long they are.

    Rows without words stay, and all rows do where the benchmark is empty; repeated rows are judged alike, and an empty table stays empty.
    """
    bad = find_contamination(docs, benchmark, window).filter("n_hit > 0").select(F.col("doc_id").alias("_lg_id"), F.col("row_key").alias("_lg_key")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_lg_id")) & (F.xxhash64(text) == F.col("_lg_key"))
    return docs.join(bad, on, "left_anti")
