"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (UTF-8 bytes, word edges marked by a
space), hashed into a table of embeddings; a word's vector is the mean of its
n-grams', a window's the mean of its words', and a two-class softmax reads the
window. A document is as toxic as its most toxic window, so a few words
don't drown in a long text; in training the gradient of a document's label goes
to that window. Misspellings share most n-grams with the word they bend.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import slices, small_batches
from loomgrid.llm.words import NOT_SPACE, Words, mix

N_GRAMS = (3, 4, 5, 6)
TABLE_BITS = 18
WINDOW = 32
DIM = 8
#: Bounds of the sample the model is fitted on: rows of each class, and bytes of a text in it.
SAMPLE, SAMPLE_BYTES = 1500, 6_000


def _raw(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def word_grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """N-gram table indices, and the number of the word each belongs to."""
    data = np.concatenate([[32], words.data, [32] * max(N_GRAMS)]).astype(np.uint64)
    # A word's n-grams start at its opening mark (one byte before it) and end by its closing mark.
    size = words.ends - words.starts + 2
    at = np.repeat(words.starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    last = np.repeat(words.ends + 2, size)
    own = np.repeat(np.arange(len(size), dtype=np.int32), size)
    h = np.zeros(len(at), np.uint64)
    grams, owners = [], []
    for k in range(max(N_GRAMS)):
        h = h * np.uint64(0x100000001B3) + data[np.minimum(at + k, len(data) - 1)]
        if k + 1 in N_GRAMS:
            ok = at + k + 1 <= last
            grams.append((mix(h[ok] + np.uint64(k)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
            owners.append(own[ok])
    return np.concatenate(grams), np.concatenate(owners)


def _means(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owners, values, n) / np.maximum(np.bincount(owners, minlength=n), 1)


def windows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Window number of each word, and the text of each window; windows don't cross texts."""
    first = np.cumsum(words.counts) - words.counts
    place = np.arange(len(words.text)) - first[words.text]
    per_text = -(-words.counts // WINDOW)
    base = np.cumsum(per_text) - per_text
    return base[words.text] + place // WINDOW, np.repeat(np.arange(len(per_text)), per_text)


class Toxicity:
    """Fitted model: ``table`` is each n-gram's embedding times the softmax's weight difference."""

    def __init__(self, table: np.ndarray, bias: float) -> None:
        self.table, self.bias = table.astype(np.float32), float(bias)

    def logits(self, raws: list[bytes]) -> np.ndarray:
        """Highest window logit of each text; the bias alone for a text without words."""
        out = np.full(len(raws), -np.inf)
        words = Words(raws, NOT_SPACE, hashes=False)
        if len(words.starts):
            grams, owners = word_grams(words)
            scores = _means(self.table[grams], owners, len(words.starts))
            window, text = windows(words)
            np.maximum.at(out, text, _means(scores, window, len(text)))
        return np.where(np.isinf(out), 0.0, out) + self.bias


def fit(texts: list[str], toxic: np.ndarray, share_toxic: float | None = None, epochs: int = 60, rate: float = 0.02, decay: float = 3e-4, least: int = 4, scale: float = 100.0, seed: int = 0) -> Toxicity:
    """Full-batch Adam over embeddings and softmax, for two thirds of the epochs on the windows' mean, then on the highest window.

    ``scale`` is a fixed factor of the averaged vector, so that one word of a window
    can outweigh the bias within few epochs. N-grams met in fewer than ``least`` texts keep a zero vector.
    Classes weigh alike in training; the bias then moves three quarters of the way to ``share_toxic``.
    """
    y = np.asarray(toxic, float)
    if not len(texts) or y.min() == y.max():
        return Toxicity(np.zeros(1 << TABLE_BITS), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    raws = [_raw(t) for t in texts]
    words = Words(raws, NOT_SPACE)
    _, first, word = np.unique(words.hashes, return_index=True, return_inverse=True)
    raw = words.data.tobytes()
    vocabulary = [raw[i:j] for i, j in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
    in_texts = np.bincount(np.unique(words.text * len(first) + word) % len(first), minlength=len(first))
    window, text = windows(words)
    del raw, words
    grams, owners = word_grams(Words(vocabulary, NOT_SPACE, hashes=False))
    n_grams = np.maximum(np.bincount(owners, minlength=len(first)), 1).astype(np.float32)
    often = np.bincount(grams, in_texts[owners], 1 << TABLE_BITS) >= least
    grams, owners = grams[often[grams]], owners[often[grams]]
    used, grams = np.unique(grams, return_inverse=True)
    n_words = np.bincount(window, minlength=len(text))
    starts = np.searchsorted(window, np.arange(len(text)))
    bounds = np.searchsorted(text, np.arange(len(texts)))
    per_text = np.bincount(text, minlength=len(texts))
    full = np.flatnonzero(per_text)
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.01, (len(used), DIM)).astype(np.float32)
    w = rng.normal(0, 0.5, DIM).astype(np.float32)
    b = np.zeros(1, np.float32)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, w, b)]
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for step in range(1, epochs + 1):
        s_word = np.bincount(owners, (e @ w)[grams], len(first)) / n_grams
        s_window = np.add.reduceat(s_word[word], starts) / n_words
        share = 1.0 / per_text[text]
        if step > epochs * 2 // 3:
            best = np.repeat(np.maximum.reduceat(s_window, bounds[full]), per_text[full])
            share = (s_window == best).astype(float)
            share /= np.bincount(text, share, len(texts))[text]
        z = scale * np.bincount(text, s_window * share, len(texts)) + b
        g = (1 / (1 + np.exp(-z)) - y) * weight
        per_window = scale * g[text] * share / n_words
        per_word = np.bincount(word, np.repeat(per_window, n_words), len(first)) / n_grams
        per_gram = np.bincount(grams, per_word[owners], len(used)).astype(np.float32)
        grads = (per_gram[:, None] * w[None, :] + decay * e, e.T @ per_gram + decay * w, np.array([g.sum()], np.float32))
        for x, grad, s in zip((e, w, b), grads, state, strict=True):
            s[0] += 0.1 * (grad - s[0])
            s[1] += 0.01 * (grad * grad - s[1])
            x -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    out = np.zeros(1 << TABLE_BITS)
    out[used] = scale * (e @ w)
    share = min(max(y.mean() if share_toxic is None else share_toxic, 1e-4), 1 - 1e-4)
    return Toxicity(out, float(b[0] + 0.75 * np.log(share / (1 - share))))


#: Bytes of text scored at once.
SLICE = 1 << 19


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[list[str], np.ndarray, float]:
    """At most ``size`` labelled texts of each class, chosen by a hash of doc_id, without the held-out remainder;
    and the share of toxic rows among all labelled ones that aren't held out.

    Texts above SAMPLE_BYTES stay out of the sample; the sample only fits the model.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    short = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES)
    out: list[tuple[str, int]] = []
    for c in (0, 1):
        ids = known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id")).limit(size)
        out += [(r.text or "", r.toxic) for r in short.join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text").limit(2 * size).collect()]
    share = known.agg(F.avg("toxic")).first()[0]
    return [t for t, _ in out], np.array([y for _, y in out]), share


def _score(model) -> Callable:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Toxicity = model.value
        for b in slices(batches, 1, SLICE):
            raws = [_raw(t or "") for t in b.column(1).to_pylist()]
            score = 1 / (1 + np.exp(-np.clip(m.logits(raws), -60, 60)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["doc_id", "score"])

    return task


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (1 where score >= threshold).

    The model learns from labelled rows whose crc32(doc_id) % 4 is not 2 (``held_out`` marks
    the others) and reads texts only. Null and empty texts get the score of
    the bias. Null labels are ignored; without two classes the score is the
    smoothed rate. A null doc_id has held_out null. Repeated rows are scored row by row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(*sample(docs, labels)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score(model), "doc_id long, score double")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
