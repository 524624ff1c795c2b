"""Corpus operators against brute force, on awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from loomgrid.llm import chunk_dedup as CH
from loomgrid.llm import decontamination as DE
from loomgrid.llm import exact_dedup as EX
from loomgrid.llm import line_dedup as LI
from loomgrid.llm import neardup as ND
from loomgrid.llm import packing as PA
from loomgrid.llm import quality as QU
from loomgrid.llm import suffix_dedup as SU
from loomgrid.llm import toxicity as TO
from loomgrid.llm import url_filter as UR
from loomgrid.llm.suffix_array import suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, _id string, row_key string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "Tion", "éré", "ou."]) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages and lines, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    out = list(base)
    out += [base[0]] * 6 + [base[1] + " ", " " + base[1] + "\n"]
    for k in range(14):
        words = base[2].split() + passage.split()
        words[rng.randrange(len(words))] = f"edit{k}"
        out.append(" ".join(words))
    out += [f"{prose(rng, 20)} {passage} {prose(rng, 15)}" for _ in range(5)]
    line = "A line that stands in Many documents"
    out += [f"{prose(rng, 9)}\n {line}\t\n{prose(rng, 4)}\n{line.upper()}" for _ in range(5)]
    out += [None, "", " \n\t ", "x", "a b c d", "ab" * 400, "é" * 300, prose(rng, 6000), passage]
    return list(enumerate(out)) + [(5, base[5]), (None, base[6]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i else None, None if i == 3 else f"s{(i or 0) % 3}", None if i == 4 else len(t or ""), "x", "y", "z") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, texts, nothing):
    groups = collections.defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t in texts:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0))
    want = sorted((str(i), str(None if (m := min(groups[norm(t)]))[1] else m[2]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in texts)
    got = EX.exact_dedup(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    left = EX.drop_copies(docs).collect()
    assert len(left) == len(groups) and set(left[0].asDict()) == set(docs.columns)
    assert EX.exact_dedup(nothing).count() == 0 and EX.drop_copies(nothing).count() == 0
    # Rows of one doc_id that differ in white space only are copies too.
    rows = docs.sparkSession.createDataFrame([(1, "a b"), (1, "a  b"), (1, "ab "), (1, "a  b"), (2, "c"), (None, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in EX.drop_copies(rows).collect()) == [(1, "a  b"), (2, "c")]


def test_cuckoo_index():
    index = EX.CuckooIndex(4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert index.resizes and all(index.find(k) == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert len(index) == 1500 and all((index.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))


def test_lines(docs, texts, nothing):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = collections.defaultdict(set)
    for i, t in texts:
        for s in (t or "").split("\n"):
            held[key(s)].add(-1 if i is None else i)
    want = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [s for s in lines if len(key(s)) < 20 or len(held[key(s)]) < 3 or max(held[key(s)]) == i]
        want.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in LI.line_dedup(docs).collect()) == sorted(want)
    assert sum(w[3] for w in want) and LI.line_dedup(nothing).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(400):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("together", [30_000, 2])
def test_suffixes(docs, texts, nothing, monkeypatch, together):
    monkeypatch.setattr(SU, "TOGETHER", together)
    raws = [(i, (t or "").encode()) for i, t in texts]
    n = collections.Counter(b[k : k + 200] for _, b in raws for k in range(len(b) - 199))
    want = []
    for i, b in raws:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if n[b[k : k + 200]] > 1:
                gone[k : k + 200] = 1
        kept = bytes(np.frombuffer(b, np.uint8)[gone[:-1] == 0])
        want.append((str(i), bytes(kept), len(b), len(b) - len(kept), int((np.diff(np.r_[0, gone]) == 1).sum())))
    assert sorted((str(r.doc_id), bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in SU.suffix_dedup(docs).collect()) == sorted(want)
    assert SU.suffix_dedup(nothing).count() == 0


def test_chunks(docs, texts, nothing):
    h = 0
    data = np.frombuffer(prose(random.Random(1), 50).encode(), np.uint8)
    for i, x in enumerate(CH.gear_hashes(data)):
        h = ((h << 1) + int(CH.GEAR[data[i]])) % 2**32
        assert h == x
    order = sorted(set(texts), key=lambda r: (r[0] is not None, r[0] or 0, _xx(docs, r[1])))
    for least in (0, 100):
        seen, want = set(), {}
        for i, t in order:
            parts = plain_chunks((t or "").encode())
            fresh = []
            for part in parts:
                fresh.append(part not in seen)
                seen.add(part)
            runs = [(new, b"".join(p for _, p in run)) for new, run in itertools.groupby(zip(fresh, parts, strict=True), lambda x: x[0])]
            gone = [not new and len(run) >= least for new, run in runs]
            kept = b"".join(run for (_, run), out in zip(runs, gone, strict=True) if not out)
            want[i, t] = str(i), kept, len((t or "").encode()) - len(kept), sum(gone), len(parts), fresh.count(False)
        got = (CH.chunk_dedup(docs, least) if least else CH.chunk_dedup(docs)).collect()
        assert sorted((str(r.doc_id), bytes(r.kept), r.n_removed, r.n_spans, r.n_chunks, r.n_duplicates) for r in got) == sorted(want[i, t] for i, t in texts)
        assert {r.doc_id for r in got if r.n_removed} >= set(range(54, 61))
    assert CH.chunk_dedup(nothing).count() == 0


def plain_chunks(raw):
    """Chunks byte by byte: a chunk of 32 bytes or more ends where the top five bits of the rolling hash are 0, or at 512 bytes."""
    words = []
    for k in range(1, 257):
        z = k * 0x9E3779B97F4A7C15 % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        words.append(z >> 32)
    out, part, h = [], bytearray(), 0
    for x in raw:
        h = (2 * h + words[x]) % 2**32
        part.append(x)
        if len(part) == 512 or (len(part) >= 32 and h < 2**27):
            out.append(bytes(part))
            part = bytearray()
    return [*out, bytes(part)] if part else out


def _xx(docs, text):
    """Spark's own row_key of a text."""
    if not hasattr(_xx, "known"):
        from pyspark.sql import functions as F

        _xx.known = {r[0]: r[1] for r in docs.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    return _xx.known[text or ""]


def components(texts, percent=85):
    sets, up = collections.defaultdict(list), {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[-1 if i is None else i].append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if any(s and r and 100 * len(s & r) >= percent * len(s | r) for s in sets[a] for r in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("tile,bucket", [(ND.TILE, ND.BUCKET), (300, 2)])
def test_near_duplicates(docs, texts, nothing, monkeypatch, tile, bucket):
    monkeypatch.setattr(ND, "TILE", tile)
    monkeypatch.setattr(ND, "BUCKET", bucket)
    want = components(texts)
    got = ND.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    assert {(-1 if r.doc_id is None else r.doc_id): (-1 if r.component_id is None else r.component_id) for r in got} == want
    assert ND.near_duplicates(nothing).count() == 0


def test_packing(docs, texts, nothing):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PA.tokenizer_path())
    rows = PA.pack_documents(docs).toPandas()
    for i, t in texts:
        if i not in (5, None):
            ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            mine = rows[rows.doc_id == i].sort_values("start")
            assert b"".join(mine.ids) == ids.tobytes() and (mine.start == np.cumsum([0, *mine.length])[:-1]).all() and (mine.doc_tokens == len(ids)).all()
    assert [zlib.crc32(x) for x in rows.ids] == rows.ids_crc32.tolist()
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        total = int(s.length.sum())
        assert (s.offset == np.cumsum([0, *s.length])[:-1]).all() and total <= 4096 and total & (total - 1) == 0
    assert PA.pack_documents(nothing).count() == 0


@pytest.mark.parametrize("text", ["á b", "ÉTÉ <|endoftext|>x it's 12½", "İ ΣΣ \x1c a\u00a0b", "don't''S !!! éé", "가 ﬁ é́", ""])
def test_word_ids_are_the_library_s(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(PA.tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert PA.WordIds(PA.tokenizer_path()).ids([text.encode()])[0].tolist() == [*want, 2]


@pytest.mark.parametrize("block,shard", [(DE.BLOCK, DE.SHARD), (30, 40)])
def test_decontamination(spark, docs, texts, nothing, monkeypatch, block, shard):
    monkeypatch.setattr(DE, "BLOCK", block)
    monkeypatch.setattr(DE, "SHARD", shard)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    plain = dict(texts)
    items = [(10, " ".join((plain[20] or "").split()[:40])), (9, "a B! c"), (100, plain[55]), (7, None), (8, "..."), (None, plain[1]), (10, "x"), (11, prose(random.Random(9), 50))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = set()
    for item, t in items:
        w = words(t)
        if w and item is not None:
            windows |= {(str(item), tuple(w[k : k + 13])) for k in range(max(1, len(w) - 12))}
    want = []
    for i, t in texts:
        w, hit, got = words(t), set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    got.add(item)
        want.append((str(i), len(w), len(hit), sorted(got)))
    found = DE.find_contamination(docs, bench)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in found.collect()) == sorted(want)
    clean = {r.doc_id for r in DE.decontaminate(docs, bench).collect()}
    assert clean == {i for (i, t), w in zip(texts, want, strict=True) if not w[2]}
    # The longest match of each document, whatever its length, in every document that has it.
    for r in found.collect():
        if r.doc_id is not None and r.doc_id != 5:
            w, best = words(plain[r.doc_id]), (0, 0)
            for item, t in items:
                v = words(t) if item is not None else []
                best = max([best, *((k, -i) for i in range(len(w)) for j in range(len(v)) if w[i] == v[j] for k in [next((d for d in range(min(len(w) - i, len(v) - j)) if w[i + d] != v[j + d]), min(len(w) - i, len(v) - j))])])
            assert (r.longest, -r.longest_at) == best
    assert DE.find_contamination(nothing, bench).count() == 0
    assert DE.find_contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_longest_match():
    h = np.array([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 1, 4, 1, 5, 8], np.uint64)
    s = DE.Suffixes(h, np.zeros(16, int))
    t = np.array([1, 4, 1, 5, 9, 2, 7], np.uint64)
    lo, hi, reach = s.find(t, np.arange(7), np.arange(7, 0, -1), np.full(7, 4))
    assert reach.tolist() == [0, 6, 5, 4, 3, 2, 1, 0, 1, 0, 1, 4, 3, 2, 1, 0] and hi[0] - lo[0] == 2
    rng = np.random.default_rng(3)
    for _ in range(60):  # texts with copies, cut by breaks
        base = rng.integers(0, 4, 60).astype(np.uint64)
        cuts = [base[rng.integers(0, 30) : rng.integers(30, 60)] for _ in range(6)]
        texts, tests = np.repeat(np.arange(6), [len(c) for c in cuts]), base[10:50]
        left = np.arange(len(tests), 0, -1)
        _, _, reach = DE.Suffixes(np.concatenate(cuts), texts).find(tests, np.arange(len(tests)), left, left)
        want = []
        for c in cuts:
            want += [max((next((d for d in range(min(len(c) - i, len(tests) - k)) if c[i + d] != tests[k + d]), min(len(c) - i, len(tests) - k)) for k in range(len(tests))), default=0) for i in range(len(c))]
        assert reach.tolist() == want


def labelled(spark, n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        t = prose(rng, rng.randrange(5, 80))
        if bad:
            t = " ".join(w + rng.choice(["%%%", "###"]) for w in t.split()) + " grumbolt" + rng.choice("abc")
        rows.append((i, t, "en", f"s{i % 5}", len(t), "x", "y", "z"))
        labels.append((i, int(not bad), int(bad)))
    rows += [(None, None, None, None, None, None, None, None), (n, "", "de", "s1", 0, "", "", ""), (n + 1, rows[0][1] * 200, "en", "s1", -5, "", "", ""), rows[0]]
    labels += [(None, 1, 1), (n, None, None), (1, 1, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, nothing):
    docs, labels = labelled(spark)
    got = TO.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert TO.toxicity(nothing, labels).count() == 0
    assert TO.toxicity(docs, labels.limit(0)).count() == docs.count()


def test_quality(spark, nothing):
    docs, labels = labelled(spark)
    got = QU.score_quality(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 != 0) for r in held]) > 0.95
    kept = QU.keep_good(docs, labels)
    assert kept.columns == docs.columns and 250 < kept.count() < 330
    assert QU.score_quality(nothing, labels).count() == 0
    assert QU.score_quality(docs, labels.limit(0)).count() == docs.count()


def test_urls(spark):
    from pyspark.sql import functions as F

    urls = ["http://WWW.Example.com/en/a?b", "https://a.example.com/en/", "http://example.com/de/x", "x://y.net/fr/", "x://ynet/fr/", "x://net/es/#q", None, "no scheme", "x://net", "a://b.org/c://d/", "x://bad.org/1", "x://bad.org/2", "x://com?/"]
    rows = [(i, u, "%%% ### ***" if u and "bad.org" in u else "fine words here", "z") for i, u in enumerate(urls)] + [(10, urls[10], None, "z")]
    got = UR.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), UR.junk_outcome(F.col("html")), block_above=0.2).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(rows)
    assert by[0] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert by[1][2:] == ("example.com/en/", "block") and by[2][2:] == ("com/", "allow")
    assert by[3][2:] == ("net/fr/", "block") and by[4][2] is None and by[5][2:] == ("net/es/", "block")
    assert by[6][:3] == ("", "", None) and by[7][:3] == ("", "", None) and by[8] == ("net", "", None, by[8][3]) and by[9][:2] == ("b.org", "/c://d/") and by[12][:3] == ("com", "", None)
    low = {r.host: r.bad_mean for r in got}
    assert low["bad.org"] > low["b.org"]
