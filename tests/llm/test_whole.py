"""The corpus operators do the whole job: cases that a bound in them once left out."""

import io
import os
import random
import subprocess
import sys
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from loomgrid.llm import decontamination as DE
from loomgrid.llm import exact_dedup as EX
from loomgrid.llm import neardup as ND
from loomgrid.llm import packing as PA
from loomgrid.llm.words import ALNUM, Words
from tests.llm.test_operators import components, prose


def test_near_stage_at_80(spark):
    rng, texts = random.Random(8), []
    for k in range(60):
        words = prose(rng, 54).split()
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:25], "other", *words[26:]]))]  # 45 of 55 shingles: 0.818
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    want = components(texts, 80)
    assert {r.doc_id: r.component_id for r in ND.near_duplicates(docs, 80).collect()} == want
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == list(range(0, 120, 2))
    assert all(r.kept for r in ND.near_duplicates(docs).collect())
    with pytest.raises(ValueError):
        ND.near_duplicates(docs, 60)


def test_packing_puts_near_copies_together(spark, monkeypatch):
    monkeypatch.setattr(PA, "SHARD", 4000)
    rng, rows = random.Random(4), []
    for k in range(60):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(80)]
        rows += [(k, " ".join(words)), (1000 + k, " ".join([*words[:40], "other", *words[41:]]))]
    got = PA.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), with_ids=False).collect()
    shard = {r.doc_id: r.sequence_id >> 32 for r in got}
    tokens = {r.doc_id: r.doc_tokens for r in got}
    sizes = np.bincount(list(shard.values()), [tokens[i] for i in shard])
    assert len(shard) == 120 and len(sizes) >= 5 and sizes.max() < 2 * sizes.mean()
    assert sum(shard[k] == shard[1000 + k] for k in range(60)) >= 48


def test_packing_scores_all_terms():
    rng = np.random.default_rng(1)
    docs = [np.unique(rng.zipf(1.3, 200) % 3000).astype("<u2") for _ in range(80)]
    df = np.bincount(np.concatenate(docs), minlength=1 << 16)
    idf = np.log(1 + (80 - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = sum(map(len, docs)) / 80
    index, unused = PA.Index(docs, idf, mean), np.arange(80) % 3 == 0
    weight = lambda d: (PA.K1 + 1) / (1 + PA.K1 * (1 - PA.B + PA.B * len(d) / mean))
    want = np.array([idf[np.intersect1d(d, docs[9])].sum() * weight(d) for d in docs])
    assert np.allclose(index.scores(docs[9]), want, atol=1e-3)
    index.without(unused)
    assert np.allclose(index.scores(docs[9])[unused], want[unused], atol=1e-3)


ALONE = """
import ctypes, pickle, sys
import pyarrow as pa
def held():
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(x.split()[1]) for x in f if x.startswith("Pss_Anon:")) / 1024
task = pickle.load(sys.stdin.buffer)
batches = pa.ipc.open_stream(sys.stdin.buffer).read_all().to_batches()
list(task(iter(batches[:1])))
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
before = held()
print(sum(b.num_rows for b in task(iter(batches))), held() - before)
"""


def test_tasks_give_memory_back(spark, monkeypatch):
    """A worker that has made the sets of 7 MB of texts is about as large as before."""
    rng, words = random.Random(1), [f"w{k:x}" for k in range(20000)]
    tasks, frame = {}, type(spark.range(1))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, *a, **b: (tasks.update({schema: f}), plain(self, f, schema, *a, **b))[1])
    text = " ".join(words[:100])
    ND.near_duplicates(spark.createDataFrame([(1, text), (2, text + " more")], "doc_id long, text string"))
    ids = list(range(4000))
    rows = pa.table({"cluster": ids, "rep": ids, "large": ids, "text": [" ".join(rng.choices(words, k=300)) for _ in ids]})
    sent = io.BytesIO(cloudpickle.dumps(tasks[ND.SETS]))
    sent.seek(0, 2)
    with pa.ipc.new_stream(sent, rows.schema) as out:
        out.write_table(rows, 1000)
    got = subprocess.run([sys.executable, "-c", ALONE], input=sent.getvalue(), capture_output=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    n, grown = got.stdout.split()
    assert int(n) == 4000 and float(grown) < 8


def test_components_write_no_round_that_changes_nothing(spark, monkeypatch):
    written, table = [], ND.table
    monkeypatch.setattr(ND, "table", lambda df, name: (written.append(name), table(df, name))[1])
    stars = spark.createDataFrame([(1, 5), (7, 1), (9, 8), (3, 3)], "a long, b long")
    assert sorted((r.node, r.least) for r in ND.components(stars, "stars").collect()) == [(5, 1), (7, 1), (9, 8)] and len(written) == 1
    path = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(50, 60), (60, 50), (61, 60)], "a long, b long")
    assert sorted((r.node, r.least) for r in ND.components(path, "path").collect()) == [(k, 1) for k in range(2, 41)] + [(60, 50), (61, 50)]
    written.clear()
    text = " ".join(map(str, range(60)))
    assert ND.near_duplicates(spark.createDataFrame([(1, text), (2, text + " more")], "doc_id long, text string")).filter("kept").count() == 1
    assert sorted(x for x in written if "edges" in x or "clusters" in x or "components" in x) == ["near-cluster-edges", "near-link-edges"]


def test_exact_has_one_worker_a_task(spark, monkeypatch):
    """Digests are folded by the worker that took them, and small shards are joined: few files."""
    plans, files, table = [], [], EX.table

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        files.append(len((out := table(df, name)).inputFiles()))
        return out

    monkeypatch.setattr(EX, "table", noted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = EX.exact_dedup(spark.createDataFrame([(k, f"text {k % 300}" + " " * (k % 2)) for k in range(900)], "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r.doc_id % 300, r.keep_id, r.group_size) for r in got} == {(k, min((k, k + 300, k + 600), key=lambda i: (-(i % 2), i)), 3) for k in range(300)}
    assert len(got) == 900 and sum(r.kept for r in got) == 300
    assert [p.split("Initial Plan")[-1].count("MapInArrow") for p in plans] == [2] and files[0] <= 10


def test_shard_words_are_made_in_slices():
    rng = random.Random(5)
    texts = ["", "  . ", *(prose(rng, 400) for _ in range(2000)), "é Ab9", "-"]
    (held, words), *more = DE.shards(pa.table({"doc_id": range(len(texts)), "text": texts, "row_key": range(len(texts))}).to_batches(500), 10**9)
    raws = [t.encode().lower() for t in texts]
    want = Words(raws, ALNUM)
    assert not more and sum(b.num_rows for b in held) == len(texts)
    assert (words.counts == want.counts).all() and (words.text == want.text).all() and (words.hashes == want.hashes).all()
    size = sum(map(len, raws))
    tracemalloc.start()
    try:
        list(DE.shards(held, 10**9))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert size > 4e6 and most < 20 * size
