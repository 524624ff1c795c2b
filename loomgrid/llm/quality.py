"""Quality classifier by co-training: a text view and a metadata view teach each other.

The text view reads frequencies of byte-class pairs and shapes of words and lines;
the metadata view reads source, language and declared length. Each is a
logistic regression fitted on a labelled sample. In each round both score all
unlabelled documents, and the most confident ones of each class join the other
view's training set as pseudo-labels. The views are then calibrated on labelled rows kept out
of their training, and their log-odds are added (less the prior, counted twice).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import slices, small_batches, table, tidy

#: Bound of the labelled sample; pseudo-labels of each class, view and round; rounds; least confidence of a pseudo-label.
SAMPLE, NEW, ROUNDS, SURE = 6000, 150, 3, 0.95
SOURCES, LANGS, LENGTHS = 64, 16, 16
CLASSES = 8
N_TEXT = CLASSES * CLASSES + 4
N_META = SOURCES + LANGS + LENGTHS


def _classes() -> np.ndarray:
    """Byte classes: other marks 0, lower 1, upper 2, digit 3, space 4, line end 5, sentence marks 6, non-ASCII 7."""
    out = np.zeros(256, np.uint8)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 1, 2, 3
    out[[32, 9]], out[[10, 13]], out[128:] = 4, 5, 7
    out[[ord(c) for c in ".,;:'\"-?()"]] = 6
    return out


BYTE_CLASS = _classes()


def text_features(raw: bytes) -> np.ndarray:
    """Roots of the class-pair frequencies, and the shares of distinct words, distinct lines, and lengths of both."""
    out = np.zeros(N_TEXT, np.float32)
    if not raw:
        return out
    c = BYTE_CLASS[np.frombuffer(raw, np.uint8)]
    if len(c) > 1:
        out[: CLASSES * CLASSES] = np.sqrt(np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES) / (len(c) - 1))
    words, lines = raw.split(), raw.split(b"\n")
    out[-4] = len(set(words)) / max(1, len(words)) ** 0.9
    out[-3] = len(set(lines)) / len(lines)
    out[-2] = np.log1p(len(raw) / max(1, len(words))) / 4
    out[-1] = np.log1p(len(raw) / len(lines)) / 8
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """One place for the source, one for the language, one for the length; null is a value of its own."""
    out = np.zeros(N_META, np.float32)
    place = lambda x, n: 0 if x is None else 1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (n - 1)
    out[place(source, SOURCES)] = 1
    out[SOURCES + place(lang, LANGS)] = 1
    out[SOURCES + LANGS + (0 if n_chars is None else 1 + min(LENGTHS - 2, int(max(n_chars, 0)).bit_length() * 2 // 3))] = 1
    return out


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 2):
        text = [text_features(x).tobytes() for x in b.column(2).cast(pa.binary()).to_pylist()]
        meta = [meta_features(*x).tobytes() for x in zip(*(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text), pa.array(meta)], names=["doc_id", "row_key", "text", "meta"])


FEATURES = "doc_id long, row_key long, text binary, meta binary"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, and both views' vectors (32-bit floats) of each row of documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(tidy(_features), FEATURES)


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 12) -> np.ndarray:
    """Weights and, last, the bias, by damped Newton steps with balanced classes."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return w
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + decay * w
        h = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + decay * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ w[:-1] + w[-1]


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a view's logits into log-odds (of unbalanced classes)."""
    if not len(y) or y.min() == y.max():
        return 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum()])
        s = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * z * z).sum() + 1e-2, (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
    return max(float(a), 0.0), float(b)


def _views(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw = [b"".join(b.column(b.schema.get_field_index(k)).to_pylist()) for k in ("text", "meta")]
    return np.frombuffer(raw[0], np.float32).reshape(-1, N_TEXT), np.frombuffer(raw[1], np.float32).reshape(-1, N_META)


SURE_ROWS = "view int, label int, z double, doc_id long, row_key long, text binary, meta binary"


def _most_sure(shared, new: int) -> Callable:
    """Each task's ``new`` surest rows for each view and class."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.log(SURE / (1 - SURE))
        held: dict[tuple[int, int], list] = {(v, c): [] for v in (0, 1) for c in (0, 1)}
        for b in batches:
            for view, (x, w) in enumerate(zip(_views(b), shared.value, strict=True)):
                z = logits(x, w)
                for label, s in ((1, z), (0, -z)):
                    at = np.flatnonzero(s >= least)
                    at = at[np.argsort(-s[at], kind="stable")[:new]]
                    rows = zip(s[at].tolist(), *(c.take(pa.array(at)).to_pylist() for c in b.columns), strict=True)
                    key = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
                    held[view, label] = sorted([*held[view, label], *rows], key=key)[:new]
        rows = [(v, c, *r) for (v, c), rs in held.items() for r in rs]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["view", "label", "z", "doc_id", "row_key", "text", "meta"])

    return task


class CoTrained:
    """Weights and calibration of both views, and the prior log-odds."""

    def __init__(self, weights, scales, prior: float) -> None:
        self.weights, self.scales, self.prior = weights, scales, prior

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of good quality by text, by metadata, and by both."""
        odds = [a * logits(x, w) + b for x, w, (a, b) in zip((text, meta), self.weights, self.scales, strict=True)]
        p = [1 / (1 + np.exp(-np.clip(z, -60, 60))) for z in (*odds, odds[0] + odds[1] - self.prior)]
        return p[0], p[1], p[2]


def co_train(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, new: int = NEW, rounds: int = ROUNDS) -> CoTrained:
    """Fit on ``rows`` (see features) and labels (doc_id, quality), those with crc32(doc_id) % 4 = 2 held out.

    At most ``sample`` labelled documents are used, chosen by a hash; a quarter of them calibrates.
    """
    spark = rows.sparkSession
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    ids = known.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).orderBy(F.xxhash64("doc_id")).limit(sample)
    got = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "row_key", "quality", "text", "meta").orderBy("doc_id", "row_key").limit(2 * sample).collect()
    y = np.array([r.quality for r in got], float)
    x = [np.frombuffer(b"".join(r[k] for r in got), np.float32).reshape(-1, n) for k, n in (("text", N_TEXT), ("meta", N_META))]
    kept = np.array([zlib.crc32(f"calibrate {r.doc_id}".encode()) % 4 == 0 for r in got], bool)
    train = [(x[v][~kept], y[~kept]) for v in (0, 1)]
    weights = [fit_logistic(*t) for t in train]
    pool = rows.join(known.select("doc_id"), "doc_id", "left_anti")
    used: set[tuple] = set()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)
        sure = pool.mapInArrow(tidy(_most_sure(shared, new + len(used))), SURE_ROWS)
        sure = table(sure, "quality-sure")
        tops = [sure.filter((F.col("view") == v) & (F.col("label") == c)).orderBy(F.desc("z"), "doc_id", "row_key").limit(new + len(used)) for v in (0, 1) for c in (0, 1)]
        ranked = reduce(DataFrame.unionAll, tops).collect()
        ranked.sort(key=lambda r: (-r.z, r.doc_id is not None, r.doc_id or 0, r.row_key))
        more: list[list] = [[], []]
        for view in (0, 1):
            for label in (0, 1):
                fresh = [r for r in ranked if r.view == view and r.label == label and (view, r.doc_id, r.row_key) not in used][:new]
                used.update((view, r.doc_id, r.row_key) for r in fresh)
                more[1 - view] += [(r.meta if view == 0 else r.text, label) for r in fresh]
        if not any(more):
            break
        for v, n in ((0, N_TEXT), (1, N_META)):
            if more[v]:
                extra = np.frombuffer(b"".join(f for f, _ in more[v]), np.float32).reshape(-1, n)
                train[v] = (np.concatenate([train[v][0], extra]), np.concatenate([train[v][1], [c for _, c in more[v]]]))
                weights[v] = fit_logistic(*train[v])
    check = kept if kept.any() else ~kept
    scales = [calibrate(logits(x[v][check], weights[v]), y[check]) for v in (0, 1)]
    return CoTrained(weights, scales, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))


def _scores(model) -> Callable:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.value.score(*_views(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x) for x in p)], names=["doc_id", "row_key", "p_text", "p_meta", "score"])

    return task


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Probability of good quality of every row of ``docs``: doc_id, row_key (hash of the text), p_text, p_meta, score.

    docs needs doc_id, text, lang, source, n_chars; nulls in any of them are values of their own, null text is
    empty. Null or other labels are ignored; with one class or none in the sample both views give the
    smoothed rate. Repeated rows are scored alike, one by one. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = table(features(docs), "quality-features")
    model = docs.sparkSession.sparkContext.broadcast(co_train(rows, labels))
    return rows.mapInArrow(tidy(_scores(model)), "doc_id long, row_key long, p_text double, p_meta double, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, whose score is at least ``threshold``."""
    bad = score_quality(docs, labels).filter(F.col("score") < threshold).select(F.col("doc_id").alias("_lg_id"), F.col("row_key").alias("_lg_key")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_lg_id")) & (F.xxhash64(text) == F.col("_lg_key"))
    return docs.join(bad, on, "left_anti")
