"""Packing by lexical retrieval: a sharded BM25 index fills each window with unused neighbours of its seed.

Documents are tokenised once into a table and put in an order of their content: by MinHashes of their
terms, rarer terms weighing more, so that documents with much in common stand close. A shard is a range of that order of
about SHARD tokens; one task holds a shard's postings. The window of a seed takes its best
unused neighbours of the shard by BM25 (all terms of the seed as query), then, when none is left, the next
unused document. The document that does not fit is cut and seeds the next window.
What is left at a shard's end is cut into powers of two, so nothing is padded.
Document frequencies and the mean length are those of all documents.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import BATCH_BYTES, documents, slices, small_batches, table, tidy
from loomgrid.llm.neardup import by_group
from loomgrid.llm.words import mix

LENGTH, END = 4096, 2
SHARD = 4_000_000
K1, B = 1.2, 0.75
#: MinHashes in a document's place, and places that the bounds of a shard are taken from.
PLACES, BOUNDS = 8, 200
#: Terms in more than 1 / DENSE of a shard's documents are held as rows of a matrix.
DENSE = 8
#: Words whose ids a worker remembers, in two generations: when the younger has half of them, the older one goes.
REMEMBERED = 1_000_000

_tokenizers: dict[str, "WordIds"] = {}


def tokenizer_path() -> str:
    """The default vocabulary file; the path is a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters and other characters of Latin-1 as the vocabulary's splitter classes them; words with any other character go to the library.
_LETTER, _NUMBER = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|\n|[^\n{_LETTER}{_NUMBER}]+")
_PLAIN = re.compile("[\n\x21-\x7e\u00a1-\u00ff]*")
NONE = np.int32(np.iinfo(np.int32).max)
EMPTY = np.uint32(np.iinfo(np.uint32).max)  # no pair: symbols stay below 65,535


class Merges:
    """Byte-pair merges of many parts at once, from the vocabulary file's own merge list."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([(vocab[x] << 16) | vocab[y] for x, y in pairs], np.uint32)
        made = np.array([vocab[x + y] for x, y in pairs], np.uint32)
        self.bits = 18
        self.keys, self.ranks = np.full(1 << self.bits, EMPTY), np.full(1 << self.bits, NONE, np.int32)
        self.made = made
        at, rank = self._slot(key), np.arange(len(key))
        self.probes = 0
        while len(key):  # linear probing, all keys a step at a time
            free = self.keys[at] == EMPTY
            _, lead = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            lead = lead[free[lead]]
            self.keys[at[lead]], self.ranks[at[lead]] = key[lead], rank[lead]
            rest = np.ones(len(key), bool)
            rest[lead] = False
            key, rank, at = key[rest], rank[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = iter(range(256, 512))
        alphabet = [chr(x) if x in plain else chr(next(other)) for x in range(256)]
        self.inner = np.array([vocab[c] for c in alphabet], np.uint32)
        self.last = np.array([vocab[c + suffix] for c in alphabet], np.uint32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int32)

    def rank(self, key: np.ndarray) -> np.ndarray:
        at = self._slot(key)
        here = self.keys[at]
        out = np.where(here == key, self.ranks[at], NONE)
        todo = np.flatnonzero((here != key) & (here != EMPTY))
        for step in range(1, self.probes):
            if not len(todo):
                break
            where = (at[todo] + step) & ((1 << self.bits) - 1)
            here = self.keys[where]
            hit = here == key[todo]
            out[todo[hit]] = self.ranks[where[hit]]
            todo = todo[~hit & (here != EMPTY)]
        return out

    def ids(self, text: str) -> tuple[bytes, list[int]]:
        """Ids (unsigned 16-bit) of all lines of ``text`` (lower-cased Latin-1), and where each line's bytes begin."""
        parts = np.fromiter(map(len, _PART.findall(text)), np.int64)
        latin, data = np.frombuffer(text.encode("latin-1"), np.uint8), np.frombuffer(text.encode(), np.uint8)
        size = np.add.reduceat(1 + (latin > 127), np.cumsum(parts) - parts)
        last = np.cumsum(size) - 1
        symbol = self.inner[data]
        symbol[last] = self.last[data[last]]
        place = np.flatnonzero(data != 10).astype(np.int32)
        symbol, part = symbol[place], np.repeat(np.arange(len(parts), dtype=np.int32), size)[place]
        rank = np.full(len(symbol), NONE)
        self._rerank(rank, symbol, part, np.arange(len(symbol)))
        out = np.full(len(data), EMPTY)
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(part)]))
            live = least != NONE
            if not live.all():
                out[place[~live]] = symbol[~live]
                symbol, part, place, rank, least = symbol[live], part[live], place[live], rank[live], least[live]
            hit = np.flatnonzero(rank == least)
            if not len(hit):
                continue
            # Of overlapping places (a run of one symbol) every other one, from the left.
            run = np.maximum.accumulate(np.where(np.r_[True, hit[1:] != hit[:-1] + 1], np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            symbol, part, place, rank = symbol[keep], part[keep], place[keep], rank[keep]
            # Only pairs beside a merge have a new rank.
            at = hit - np.arange(len(hit))
            self._rerank(rank, symbol, part, np.r_[at, at[at > 0] - 1])
        got = np.flatnonzero(out != EMPTY)
        breaks = np.flatnonzero(data == 10)
        cuts = 2 * np.searchsorted(got, np.r_[0, breaks, len(data)])
        return out[got].astype("<u2").tobytes(), cuts.tolist()

    def _rerank(self, rank: np.ndarray, symbol: np.ndarray, part: np.ndarray, at: np.ndarray) -> None:
        """Set the ranks of the pairs that begin at ``at``; a part's last symbol begins none."""
        inside = at[at + 1 < len(symbol)]
        inside = inside[part[inside] == part[inside + 1]]
        rank[at] = NONE
        rank[inside] = self.rank((symbol[inside] << np.uint32(16)) | symbol[inside + 1])


class WordIds:
    """Ids of texts as the vocabulary file's tokenizer gives them, word by word.

    Its normaliser and splitter never look across white space, so a text's
    ids are those of its words, and a word's ids can be remembered. New words of Latin-1 are
    split and merged here, many at once; all others are given to the library.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        if any("<|" not in t.content for t in self.model.get_added_tokens_decoder().values()):
            raise ValueError("special tokens without <| aren't told apart from plain words")
        self.merges = Merges(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        text = b"\n".join(words).decode("utf-8", "replace")
        if not _PLAIN.fullmatch(text) or "<|" in text:
            plain = [w for w, t in zip(words, text.split("\n"), strict=True) if "<|" not in t and _PLAIN.fullmatch(t)]
            for w in set(words).difference(plain):
                self.known[w] = np.array(self.model.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u2").tobytes()
            words, text = plain, b"\n".join(plain).decode()
        if words:
            raw, cuts = self.merges.ids(text.lower())
            self.known.update(zip(words, [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], strict=True))

    def ids(self, raws: pa.Array | list[bytes]) -> list[np.ndarray]:
        """Ids of each text and END after them, as unsigned 16-bit numbers. Only the different words of the texts are looked up."""
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        self.known[b""] = b""  # beside white space at a text's ends
        texts = raws if isinstance(raws, pa.Array) else pa.array(raws, pa.binary())
        split = pc.ascii_split_whitespace(texts.view(pa.string()))
        coded = split.flatten().dictionary_encode()
        one = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.view(pa.binary()))
        words = pc.binary_join(one, b"\n")[0].as_py().split(b"\n") if len(coded) else []
        found = list(map(self.known.get, words))
        gaps = [i for i, x in enumerate(found) if x is None]
        new = []
        for w in map(words.__getitem__, gaps):
            if w in self.older:
                self.known[w] = self.older[w]
            else:
                new.append(w)
        if new:
            self._learn(new)
        for i in gaps:
            found[i] = self.known[words[i]]
        joined = pa.array(found, pa.binary()).take(coded.indices)
        _, ends, data = joined.buffers()
        cuts = (np.frombuffer(ends, np.int32)[split.offsets.to_numpy()] // 2 if len(joined) else np.zeros(len(texts) + 1, int)).tolist()
        ids = np.frombuffer(data or b"", "<u2")
        end = np.array([END], "<u2")
        return [np.concatenate([ids[i:j], end]) for i, j in zip(cuts, cuts[1:], strict=False)]


def _gathered(batches: Iterable[pa.RecordBatch], least: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches joined to ``least`` bytes: the more texts at once, the fewer different words each of them has."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _tokens(path: str) -> Callable:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizers.get(path) or _tokenizers.setdefault(path, WordIds(path))
        for b in slices(_gathered(batches), 1, BATCH_BYTES):
            ids = coder.ids(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())], names=["doc_id", "row_key", "ids", "n"])

    return task


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << 16, np.int64)
    for b in batches:
        for raw in b.column(0).to_pylist():
            df[np.unique(np.frombuffer(raw, "<u2"))] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], names=["term", "df"])


def draws(idf: np.ndarray) -> np.ndarray:
    """PLACES rows of exponential draws, one of rate idf for each term: the least of a document's terms is its MinHash."""
    at = np.arange(1, PLACES * len(idf) + 1, dtype=np.uint64).reshape(PLACES, -1)
    unit = ((mix(at) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
    return (-np.log(unit) / np.maximum(idf, 1e-6)).astype(np.float32)


def place(doc: np.ndarray, row: int, drawn: np.ndarray) -> bytes:
    """Place of a document among all: its MinHashes, then a hash of the row so that no group of equals is too large for a shard."""
    return doc[np.take(drawn, doc, axis=1).argmin(axis=1)].astype(">u2").tobytes() + (row & (2**64 - 1)).to_bytes(8, "big")


def bounds(places: list[tuple[bytes, int]], n_shards: int) -> list[bytes]:
    """First places of all shards but the first, by equal shares of the tokens of ``places`` (place, tokens)."""
    places = sorted(places)
    ends = np.cumsum([n for _, n in places])
    at = np.searchsorted(ends, np.arange(1, n_shards) * (ends[-1] / n_shards)) if places else []
    return sorted({places[i][0] for i in at})


def _places(shared, step: int) -> Callable:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (row, ids, n): places of a part of the rows with the tokens each stands for, long rows all."""
        drawn = draws(shared.value[0])
        for b in batches:
            found = [(place(np.frombuffer(x, "<u2"), k, drawn), max(n, step)) for k, x, n in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True) if k % step < n]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["place", "n"])

    return task


def _dealt(shared, firsts: list[bytes]) -> Callable:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = draws(shared.value[0])
        for b in batches:
            shard = [bisect_right(firsts, place(np.frombuffer(x, "<u2"), k, drawn)) for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), b.column(2), b.column(3), b.column(1)], names=["shard", "doc_id", "row_key", "ids"])

    return task


class Index:
    """BM25 postings of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        pairs = [np.unique(d, return_counts=True) for d in docs]
        n = np.array([len(t) for t, _ in pairs])
        terms = np.concatenate([t for t, _ in pairs])
        tf = np.concatenate([c for _, c in pairs]).astype(np.float32)
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), n)
        size = np.repeat(np.array([len(d) for d in docs], np.float32), n)
        weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        order = np.argsort(terms, kind="stable")
        self.owner, self.weight, self.term = owner[order], weight[order].astype(np.float32), terms[order]
        self.n = self.left = len(docs)
        self._arrange()

    def _arrange(self) -> None:
        self.starts = np.searchsorted(self.term, np.arange((1 << 16) + 1))
        common = np.flatnonzero(np.diff(self.starts) * DENSE > self.left)
        self.line = np.full(1 << 16, -1)
        self.line[common] = np.arange(len(common))
        # Columns of the matrix are the documents that have postings left.
        self.column = np.unique(self.owner)
        self.dense = np.zeros((len(common), len(self.column)), np.float32)
        for k, t in enumerate(common):
            at = slice(self.starts[t], self.starts[t + 1])
            self.dense[k, np.searchsorted(self.column, self.owner[at])] = self.weight[at]

    def without(self, unused: np.ndarray) -> None:
        """Drop the postings of used documents, when a quarter of the documents have been used since the last time."""
        left = int(unused.sum())
        if 4 * left <= 3 * self.left:
            keep = unused[self.owner]
            self.owner, self.weight, self.term, self.left = self.owner[keep], self.weight[keep], self.term[keep], left
            self._arrange()

    def scores(self, doc: np.ndarray) -> np.ndarray:
        """BM25 of all documents that have postings, for all terms of ``doc``."""
        terms = np.unique(doc).astype(np.int64)
        line = self.line[terms]
        asked = np.zeros(len(self.dense), np.float32)
        asked[line[line >= 0]] = 1
        out = np.zeros(self.n, np.float32)
        out[self.column] = asked @ self.dense
        at = [slice(self.starts[t], self.starts[t + 1]) for t in terms[line < 0].tolist()]
        if not at:
            return out
        return out + np.bincount(np.concatenate([self.owner[s] for s in at]), np.concatenate([self.weight[s] for s in at]), self.n)


def pack(docs: list[np.ndarray], index: Index, length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, first id, ids), each of ``length`` ids but for the last, which are powers of two."""
    unused = np.ones(len(docs), bool)
    order = iter(range(len(docs)))
    out: list[list[tuple[int, int, int]]] = []
    window: list[tuple[int, int, int]] = []
    room, scores = length, None
    doc, start = None, 0
    while True:
        if doc is None:
            if scores is not None and unused.any():
                best = int(np.argmax(np.where(unused, scores, -1.0)))
                doc = best if unused[best] and scores[best] > 0 else None
            if doc is None:
                doc = next((d for d in order if unused[d]), None)
            if doc is None:
                break
            unused[doc], start = False, 0
        if scores is None:
            index.without(unused)
            scores = index.scores(docs[doc])
        take = min(room, len(docs[doc]) - start)
        window.append((doc, start, take))
        room, start = room - take, start + take
        if start == len(docs[doc]):
            doc = None
        if not room:
            out.append(window)
            window, room, scores = [], length, None
    left = length - room
    while left:
        size = 1 << (left.bit_length() - 1)
        part, left = [], left - size
        while size:
            d, s, n = window[0]
            take = min(n, size)
            part.append((d, s, take))
            window[0] = (d, s + take, n - take)
            size -= take
            if take == n:
                window.pop(0)
        out.append(part)
    return out


def _packed(shared, length: int, with_ids: bool) -> Callable:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, doc_id, row_key, ids) sorted by them."""
        idf, mean = shared.value
        for parts in by_group(batches, [0]):
            shard = parts[0].column(0)[0].as_py()
            ids = [x for p in parts for x in p.column(1).to_pylist()]
            docs = [np.frombuffer(x, "<u2") for p in parts for x in p.column(3).to_pylist()]
            rows = []
            for k, sequence in enumerate(pack(docs, Index(docs, idf, mean), length)):
                offset = 0
                for d, s, n in sequence:
                    piece = docs[d][s : s + n].astype("<u4").tobytes()
                    rows.append((ids[d], s, n, zlib.crc32(piece), len(docs[d]), (shard << 32) | k, offset, piece if with_ids else None))
                    offset += n
            for i in range(0, len(rows), 2000):
                columns = zip(*rows[i : i + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 7, pa.binary()], strict=True)], names=PIECE_NAMES)

    return task


PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``length`` ids (a power of two).

    Returns one row per piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens
    (with the closing id), sequence_id, offset in the sequence, ids (little-endian unsigned 32-bit; null unless ``with_ids``).
    A null text is empty and gives the closing id alone. Each row is a document of its own, also when
    rows repeat; a null doc_id is carried along. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = documents(docs).select("doc_id", "text", "row_key")
    tokens = table(rows.mapInArrow(tidy(_tokens(path or tokenizer_path())), "doc_id long, row_key long, ids binary, n long"), "packing-tokens")
    n_docs, n_tokens = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # The vocabulary bounds this at 65,536 rows.
    df = np.zeros(1 << 16)
    for term, n in tokens.select("ids").mapInArrow(tidy(_frequencies), "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, max(1.0, n_tokens / max(1, n_docs))))
    n_shards = max(1, -(-n_tokens // SHARD))
    row = F.xxhash64("doc_id", "row_key").alias("row")
    # A document stands for ``step`` tokens at least, so the driver gets about n_tokens / step places.
    step = max(1, n_tokens // (BOUNDS * n_shards))
    found = tokens.select(row, "ids", "n").mapInArrow(tidy(_places(shared, step)), "place binary, n long").collect() if n_shards > 1 else []
    firsts = bounds([(bytes(x), n) for x, n in found], n_shards)
    # A shard is a partition: hashing shard numbers again would put several into one task.
    placed = tokens.select(row, "ids", "doc_id", "row_key").mapInArrow(tidy(_dealt(shared, firsts)), "shard long, doc_id long, row_key long, ids binary")
    dealt = placed.repartitionById(int(n_shards), F.col("shard").cast("int")).sortWithinPartitions("shard", "doc_id", "row_key")
    return dealt.mapInArrow(tidy(_packed(shared, length, with_ids)), PIECE)
