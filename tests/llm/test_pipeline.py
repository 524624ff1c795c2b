"""The pipeline's stages against brute force; the classifier's own decisions are taken as given."""

import re

import corpus_pipeline

from tests.llm.test_operators import components, labelled, prose


def test_run(spark, tmp_path):
    docs, labels = labelled(spark, 120)
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    words = rows[1].split()
    extra = [(500, rows[1] + "  "), (501, " ".join([*rows[9].split(), *rows[5].split(), "end"])), (502, " ".join([*rows[9].split(), *rows[5].split(), "other"])), (503, prose(__import__("random").Random(2), 20) + " " + " ".join(words[:20]))]
    docs = docs.select(*corpus_pipeline.COLUMNS).unionAll(spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in extra], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words[:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, step, str(tmp_path))
        if k < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{k}.parquet")
        step = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        seen.append(step.collect())
    good, exact, near, clean, pieces = seen
    kept = {}
    for r in good:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        rank = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
        kept[key] = min(kept.get(key, rank), rank)
    ids = {None if x[1] else x[2] for x in kept.values()}
    assert {r.doc_id for r in exact} == ids and len(exact) == len(kept)
    groups = components([(r.doc_id, r.text) for r in exact])
    assert {-1 if r.doc_id is None else r.doc_id for r in near} == {i for i, c in groups.items() if i == c}
    leak = " ".join(words[:13]).lower()
    plain = lambda t: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))
    assert {r.doc_id for r in clean} == {r.doc_id for r in near if plain(leak) not in plain(r.text)}
    assert {r.doc_id for r in pieces} == {r.doc_id for r in clean}
    assert corpus_pipeline.ORACLE_SQL is None
