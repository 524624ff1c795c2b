"""Near-duplicate documents: MinHash signatures joined by multi-index Hamming, confirmed on full sets.

A document is its set of distinct five-word shingles. Equal sets fold to one
representative. Its signature has symbols of 16 bits (one MinHash each) in chunks of four: six chunks
for similarity 0.85, eight for 0.80 (``chunk_count``). If two signatures differ in fewer symbols than twice the
chunks, then by pigeonhole some chunk differs in at most one; enumerating that one allowed error as a wildcard
(four patterns of three symbols a chunk) makes every such pair share a key. A pair at
the least similarity asked for is outside that distance and all chunks with probability 2e-6 at most.

Keys are not expanded into pairs. Within a key's bucket the documents
whose 64 symbols agree as well form local components, which give one edge for each document; the
components of those edges are clusters, each a superset of the linked documents. Buckets above BUCKET count as one component.

Inside a cluster full shingle sets are compared, one document against all others of its tile, until one component is left
(``linked``), which gives one edge for each document. A cluster too large for a task is first compared with a few of its members; only
what that leaves open is cut into tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import documents, lookup, slices, small_batches, table, tidy
from loomgrid.llm.words import NOT_SPACE, Words, mix

SHINGLE = 5
PER_CHUNK, SYMBOLS = 4, 64
#: Largest probability that a pair at the least similarity shares no chunk pattern, or that too few of its symbols agree in a bucket.
NO_KEY, TOO_FEW = 2e-6, 1e-8
#: Documents of a bucket whose signatures one task compares; load of a tile, where a document counts its shingles and DOCUMENT more.
BUCKET, TILE, DOCUMENT = 1000, 500_000, 25
#: Documents of a tile whose distances to all others are kept.
PIVOTS = 16
SEEDS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def chunk_count(percent: int) -> int:
    """Fewest chunks of which a pair at ``percent`` matches none, one symbol of each left open, with probability NO_KEY at most."""
    s = percent / 100
    miss = 1 - s**PER_CHUNK - PER_CHUNK * s ** (PER_CHUNK - 1) * (1 - s)
    found = [k for k in range(1, SYMBOLS // PER_CHUNK + 1) if miss**k <= NO_KEY]
    if not found:
        raise ValueError(f"{SYMBOLS} symbols are too few for {percent} percent")
    return found[0]


def least_agreeing(percent: int) -> int:
    """Of the 64 symbols' low bytes so many must agree in a bucket; a pair at ``percent`` has fewer with probability TOO_FEW at most."""
    s, p, k = percent / 100, 0.0, 0
    while k < SYMBOLS and (p := p + math.comb(SYMBOLS, k) * s**k * (1 - s) ** (SYMBOLS - k)) <= TOO_FEW:
        k += 1
    return k


def shingle_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle, and the number of the text it is in; a shorter text is one shingle."""
    words = Words([x.lower() for x in raws], NOT_SPACE)
    n, h = words.counts, words.hashes
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.cumsum(n) - n
    some = np.flatnonzero(n)
    count = np.maximum(n[some] - SHINGLE + 1, 1)
    text = np.repeat(some, count)
    at = np.repeat(first[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    width = np.minimum(n, SHINGLE)[text]
    out = width.astype(np.uint64)
    for k in range(SHINGLE):
        word = np.where(k < width, h[np.minimum(at + k, len(h) - 1)], np.uint64(0))
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out, text


def shingle_sets(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and the number in each."""
    h, text = shingle_hashes(raws)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.bincount(text[new], minlength=len(raws))


def _sign(n_chunks: int) -> Callable:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            sets, n = shingle_sets(b.column(1).cast(pa.binary()).to_pylist())
            some = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[some]
            chunks = np.zeros((b.num_rows, n_chunks), np.uint64)
            low = np.zeros((b.num_rows, SYMBOLS), np.uint8)
            prints = np.zeros((b.num_rows, 2), np.uint64)
            if len(some):
                for k, seed in enumerate(SEEDS):
                    least = mix(np.minimum.reduceat(sets * seed, starts)) & np.uint64(0xFFFF)
                    low[some, k] = least
                    if k < n_chunks * PER_CHUNK:
                        chunks[some, k // PER_CHUNK] |= least << np.uint64(16 * (k % PER_CHUNK))
                for k in range(2):
                    prints[some, k] = np.add.reduceat(mix(sets + SEEDS[k]), starts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), *(pa.array(prints[:, k].view(np.int64)) for k in range(2)), *(pa.array(chunks[:, k].copy().view(np.int64)) for k in range(n_chunks)), pa.array([x.tobytes() for x in low])],
                names=["doc_id", "n_shingles", "f1", "f2", *(f"c{k}" for k in range(n_chunks)), "low"],
            )

    return task


def _signed(n_chunks: int) -> str:
    return "doc_id long, n_shingles long, f1 long, f2 long, " + ", ".join(f"c{k} long" for k in range(n_chunks)) + ", low binary"


def signatures(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, set fingerprint (f1, f2), the chunks of signature, and the 64 low bytes."""
    n_chunks = chunk_count(percent)
    return documents(docs).select("doc_id", "text").mapInArrow(tidy(_sign(n_chunks)), _signed(n_chunks))


def keys(reps: DataFrame, n_chunks: int) -> DataFrame:
    """Chunk patterns with one wildcard: four rows a chunk (key, rep) of each representative."""
    patterns = []
    for c in range(n_chunks):
        for e in range(PER_CHUNK):
            mask = ~(0xFFFF << (16 * e)) & 0xFFFFFFFFFFFFFFFF
            mask -= (mask >> 63) << 64
            patterns.append(F.xxhash64(F.lit(c * PER_CHUNK + e), F.col(f"c{c}").bitwiseAND(F.lit(mask).cast("long"))))
    return reps.select("rep", F.explode(F.array(*patterns)).alias("key"))


class Forest:
    """Union-find over 0..n-1 whose root is the smallest member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def by_group(batches: Iterable[pa.RecordBatch], group: list[int]) -> Iterator[list]:
    """Columns (as lists) of one group after the other, from batches sorted by the columns ``group``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(*(b.column(g).to_pylist() for g in group), strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and tuple(held[0].column(g)[0].as_py() for g in group) != keys[i]:
                yield held
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield held


EDGE = "a long, b long"


def _edges(batches: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*batches, strict=True) if batches else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _bucket_edges(agree: int) -> Callable:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, rep, low) sorted by key, rep: edges to the smallest member of each local component."""
        out: list[tuple[int, int]] = []
        for parts in by_group(batches, [0]):
            reps = [x for p in parts for x in p.column(1).to_pylist()]
            low = np.frombuffer(b"".join(x for p in parts for x in p.column(2).to_pylist()), np.uint8).reshape(-1, SYMBOLS)
            todo = np.arange(len(reps))
            while len(todo) > 1:  # breadth first: each round takes one unreached document and all it reaches
                reached, front = [todo[0]], [todo[0]]
                todo = todo[1:]
                while front and len(todo):
                    near = (low[todo] == low[front.pop()]).sum(axis=1) >= agree
                    front += todo[near].tolist()
                    reached += todo[near].tolist()
                    todo = todo[~near]
                least = min(reached)
                out += [(reps[x], reps[least]) for x in reached if x != least]
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return task


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Smallest node reachable (``least``) of every node of ``edges`` (a, b), by alternating large and small stars; a written table."""
    e = table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    for _ in range(rounds):
        if _stars(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("least"))
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        e = table(_star(both, larger=True), name)
        e = table(_star(e, larger=False), name)
    raise RuntimeError(f"{name}: components still change after {rounds} rounds")


def _stars(e: DataFrame) -> bool:
    """Whether each ``a`` has one ``b`` (b < a) and is nobody's ``b``: then a round changes nothing."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select("b", F.lit(0), F.lit(1)))
    wrong = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1")
    return wrong.limit(1).count() == 0


def _star(e: DataFrame, larger: bool) -> DataFrame:
    """Point neighbours of each ``a`` to the smallest of them: the larger ones, or all (rows have b < a)."""
    stats = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    total = e.count()
    met = lookup(e, stats, ["a"], "n", total)
    if larger:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(stats.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _set_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, rep, large, text): the sorted distinct shingles instead of the text, and a set's load."""
    for b in slices(batches, 3):
        sets, n = shingle_sets(b.column(3).cast(pa.binary()).to_pylist())
        ends = np.cumsum(n)
        parts = [sets[j - k : j].tobytes() for j, k in zip(ends.tolist(), n.tolist(), strict=True)]
        some = pa.array(n > 0)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n + DOCUMENT, pa.int64()), pa.array(parts, pa.binary())], names=["cluster", "rep", "large", "load", "shingles"]).filter(some)


SETS = "cluster long, rep long, large boolean, load long, shingles binary"


def linked(sets: list[np.ndarray], percent: int, family: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges of the graph of sets (sorted, not empty) with 100 * |A and B| >= percent * |A or B|; exact.

    ``family``: sets with the same number above 0 are known to be connected; those edges aren't returned.
    One document after the other is compared with all sets of a fitting size, until all but the largest component have been
    taken: any pair left lies within it. The Jaccard distance is a metric, so the distances to the first
    documents taken rule most others out beforehand. Memory is in proportion to the shingles, never to the pairs.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    order = np.argsort(size, kind="stable")
    size = size[order]
    ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    starts = np.cumsum(size) - size
    mark = np.zeros(int(ids.max()) + 1, np.int64)
    comp = np.arange(n)
    if family is not None:
        number = family[order]
        for f in np.unique(number[number > 0]):
            same = np.flatnonzero(number == f)
            comp[same] = same[0]
    members = np.bincount(comp, minlength=n)
    done = np.zeros(n, bool)
    edges: list[tuple[int, int]] = []
    pivots: list[np.ndarray] = []
    reach = (100 - percent) / 100 + 1e-9
    while len(todo := np.flatnonzero(~done & (comp != members.argmax()))):
        for x in todo.tolist():
            if comp[x] == members.argmax():
                continue
            done[x] = True
            i, j = np.searchsorted(size, [-(-percent * size[x] // 100), 100 * size[x] // percent + 1])
            able = comp[i:j] != comp[x]
            for far in pivots:
                able &= np.abs(far[i:j] - far[x]) <= reach
            if not able.any():
                continue
            mark[ids[starts[x] : starts[x] + size[x]]] = 1
            if len(pivots) < PIVOTS:
                both = np.add.reduceat(mark[ids], starts)
                pivots.append(1 - both / (size + size[x] - both))
                hit = i + np.flatnonzero(able)
                both = both[hit]
            else:
                hit = i + np.flatnonzero(able)
                k = size[hit]
                first = np.cumsum(k) - k
                both = np.add.reduceat(mark[ids[np.repeat(starts[hit] - first, k) + np.arange(k.sum())]], first)
            mark[ids[starts[x] : starts[x] + size[x]]] = 0
            hit = hit[100 * both >= percent * (size[hit] + size[x] - both)]
            if len(hit):
                others, at = np.unique(comp[hit], return_index=True)
                edges += [(int(order[x]), int(order[y])) for y in hit[at].tolist()]
                members[comp[x]] += members[others].sum()
                members[others] = 0
                comp[np.isin(comp, others)] = comp[x]
    return edges


def _confirm(percent: int):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (cluster, tile, family, rep, shingles) sorted by cluster, tile."""
        out: list[tuple[int, int]] = []
        for parts in by_group(batches, [0, 1]):
            reps = [x for p in parts for x in p.column(3).to_pylist()]
            sets = [np.frombuffer(x, np.uint64) for p in parts for x in p.column(4).to_pylist()]
            family = np.concatenate([p.column(2).to_numpy() for p in parts])
            out += [(reps[x], reps[y]) for x, y in linked(sets, percent, family)]
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return task


def _to_pivots(percent: int):
    def near(a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (cluster, rep, load, shingles, pivots): the family of a set, and the pivots it is linked with."""
        names: dict[int, tuple[list, list, list]] = {}
        for b in slices(batches, 3):
            family, links = [], []
            for cluster, shingles, given in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                if cluster not in names:
                    if len(names) > 100:
                        names.clear()
                    rows = [p for p in given.as_py() if p]
                    sets = [np.frombuffer(p["shingles"], np.uint64) for p in rows]
                    forest = Forest(len(sets))
                    for i, j in combinations(range(len(sets)), 2):
                        if near(sets[i], sets[j]):
                            forest.join(i, j)
                    names[cluster] = [p["rep"] for p in rows], sets, [forest.root(i) + 1 for i in range(len(sets))]
                reps, sets, number = names[cluster]
                mine = np.frombuffer(shingles, np.uint64)
                close = [i for i, s in enumerate(sets) if near(mine, s)]
                family.append(min((number[i] for i in close), default=0))
                links.append([reps[i] for i in close])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(family, pa.int32()), pa.array(links, pa.list_(pa.int64()))], names=["cluster", "rep", "load", "shingles", "family", "links"])

    return task


def _large_tiles(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Clusters that exceed a tile: links with pivots, and the tiles (rows as for _confirm) for what they leave open.

    Every set is compared with up to four members of its cluster. Those linked with one are a family and known to be
    connected; a cluster that is one family, as the copies of a template are, is done. Else blocks of different families, and blocks of
    sets linked with no pivot, meet two by two.
    """
    h = F.xxhash64("rep")
    picks = [F.min_by(F.struct("rep", "shingles"), F.when(F.pmod(h, F.lit(4)) == q, h)) for q in range(4)]
    pivots = table(sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*picks).alias("pivots")), "near-pivots")
    met = lookup(sets.select("cluster", "rep", "load", "shingles"), pivots, ["cluster"], "n", pivots.agg(F.sum("n")).first()[0] or 0)
    named = table(met.select("cluster", "rep", "load", "shingles", "pivots").mapInArrow(tidy(_to_pivots(percent)), "cluster long, rep long, load long, shingles binary, family int, links array<long>"), "near-families")
    known = named.select(F.col("rep").alias("a"), F.explode("links").alias("b"))
    parts = named.groupBy("cluster", "family").agg(F.ceil(F.sum("load") * 2 / TILE).alias("parts"))
    blocks = table(parts.select("cluster", "family", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("block")), "near-blocks")
    other = blocks.select("cluster", F.col("family").alias("f"), F.col("block").alias("k"))
    meet = (F.col("family") < F.col("f")) | ((F.col("family") == 0) & (F.col("f") == 0) & (F.col("block") <= F.col("k")))
    pairs = blocks.join(other, "cluster").filter(meet).withColumn("tile", F.xxhash64("family", "block", "f", "k"))
    ends = pairs.select("cluster", "family", "block", "parts", "tile").unionAll(pairs.join(blocks.select("cluster", F.col("family").alias("f"), F.col("block").alias("k"), F.col("parts").alias("q")), ["cluster", "f", "k"]).select("cluster", F.col("f"), F.col("k"), F.col("q"), "tile")).distinct()
    rows = named.join(parts, ["cluster", "family"]).withColumn("block", F.pmod(h, F.col("parts")))
    return known, rows.join(ends.drop("parts"), ["cluster", "family", "block"]).select("cluster", "tile", "family", "rep", "shingles")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Group documents linked by 100 * |A and B| >= percent * |A or B| on five-word shingles.

    Returns per row of ``docs``: doc_id, n_shingles, component_id (smallest
    doc_id reachable), kept (doc_id = component_id). A-Z count as a-z; words are
    runs of anything but space and the characters 9 to 13. A text of fewer
    than five words is one shingle. Null, empty and blank texts have none and
    are linked with nothing. Rows that share a doc_id are one node. A null doc_id is a node
    below all others (its component_id is null). An empty table gives an empty result. Signature and filter are
    dimensioned by percent; below 65 the 64 symbols don't suffice and ValueError is raised.
    """
    n_chunks = chunk_count(percent)
    spark = docs.sparkSession
    small_batches(spark)
    number = F.coalesce("doc_id", F.lit(-(2**63)))
    docs = documents(docs).withColumn("doc_id", number)
    signed = table(docs.select("doc_id", "text").mapInArrow(tidy(_sign(n_chunks)), _signed(n_chunks)), "near-signed")
    chunks = [f"c{k}" for k in range(n_chunks)]
    full = signed.filter("n_shingles > 0")
    classes = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), *(F.first(c).alias(c) for c in chunks), F.first("low").alias("low"), F.first("n_shingles").alias("n_shingles"))
    reps = table(classes, "near-classes")

    # Patterns are counted and joined without signatures, which only the rows of shared patterns then get.
    entries = keys(reps, n_chunks)
    buckets = table(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least")).filter("n > 1"), "near-buckets")
    total = buckets.agg(F.sum("n")).first()[0] or 0
    met = table(lookup(entries, buckets, ["key"], "n", total, hint="merge"), "near-met")
    small = met.filter(F.col("n") <= BUCKET).select("key", "rep").join(reps.select("rep", "low").hint("merge"), "rep").select("key", "rep", "low").repartition("key").sortWithinPartitions("key", "rep")
    large = met.filter((F.col("n") > BUCKET) & (F.col("rep") != F.col("least"))).select(F.col("rep").alias("a"), F.col("least").alias("b"))
    clusters = components(small.mapInArrow(tidy(_bucket_edges(least_agreeing(percent))), EDGE).unionAll(large), "near-cluster-edges")

    # Members of a cluster with their full sets; a cluster of at most TILE is one tile.
    nodes = clusters.unionAll(clusters.select(F.col("least").alias("node"), "least").distinct())
    members = nodes.join(reps.select(F.col("rep").alias("node"), "n_shingles"), "node").select(F.col("least").alias("cluster"), F.col("node").alias("rep"), "n_shingles")
    loads = members.groupBy("cluster").agg(F.sum(F.col("n_shingles") + DOCUMENT).alias("load"), F.count(F.lit(1)).alias("n"))
    sized = lookup(members, loads, ["cluster"], "n", members.count())
    by_id = table(full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("f1", "f2")).alias("x"), F.max(F.struct("f1", "f2")).alias("y")).filter("rows > 1"), "near-ids")
    wanted = sized.select("cluster", "rep", (F.col("load") > TILE).alias("large")).join(by_id.select(F.col("doc_id").alias("rep"), "rows"), "rep", "left").withColumn("rows", F.coalesce("rows", F.lit(1)))
    wanted = table(wanted, "near-wanted")
    again = by_id.limit(1).count() > 0
    texts = lookup(docs.select(F.col("doc_id").alias("rep"), "text", "row_key"), wanted, ["rep"], "rows", signed.count(), hint="merge")
    if again:
        texts = texts.dropDuplicates(["cluster", "rep", "row_key"])
    sets = table(texts.select("cluster", "rep", "large", "text").mapInArrow(tidy(_set_rows), SETS), "near-sets")
    tiles = sets.filter("not large").select("cluster", F.lit(0).cast("long").alias("tile"), F.lit(0).alias("family"), "rep", "shingles")
    edges = []
    if wanted.filter("large").limit(1).count():
        known, open_tiles = _large_tiles(sets.filter("large"), percent)
        tiles = tiles.unionAll(open_tiles)
        edges.append(known)
    checked = tiles.repartition("cluster", "tile").sortWithinPartitions("cluster", "tile").mapInArrow(tidy(_confirm(percent)), EDGE)
    edges = table(reduce(DataFrame.unionAll, edges, checked), "near-links")

    # Rows that share a doc_id but not a set tie their classes together as well.
    twins = by_id.filter("x <> y").select("doc_id")
    tied = full.join(twins, "doc_id").select("doc_id", "f1", "f2").join(reps.select("f1", "f2", "rep"), ["f1", "f2"]).groupBy("doc_id").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("all"))
    edges = edges.unionAll(tied.select(F.explode("all").alias("a"), "b"))
    linked_reps = components(edges, "near-link-edges")
    owners = reps.select("f1", "f2", "rep", "size").join(linked_reps.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "size", F.coalesce("least", "rep").alias("component_id"))
    owners = table(owners, "near-owners")
    n_rows = owners.agg(F.sum("size")).first()[0] or 0
    named = lookup(full.select("doc_id", "n_shingles", "f1", "f2"), owners, ["f1", "f2"], "size", n_rows)
    out = named.select("doc_id", "n_shingles", "component_id").unionAll(signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    null_low = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return out.select(null_low("doc_id").alias("doc_id"), "n_shingles", null_low("component_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all their columns, whose doc_id is their group's smallest."""
    keep = near_duplicates(docs, percent).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_lg_id")).distinct()
    return docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("_lg_id")), "left_semi")
