"""In-task kernels of the corpus operators against brute force, without Spark."""

import collections

import numpy as np
import pytest

from loomgrid.llm import neardup as ND
from loomgrid.llm import packing as PA
from loomgrid.llm import suffix_dedup as SU


def _linked_by_pairs(sets, percent):
    forest = ND.Forest(len(sets))
    plain = [set(s.tolist()) for s in sets]
    for i in range(len(sets)):
        for j in range(i):
            both = len(plain[i] & plain[j])
            if 100 * both >= percent * (len(plain[i]) + len(plain[j]) - both):
                forest.join(i, j)
    return [forest.root(i) for i in range(len(sets))]


@pytest.mark.parametrize("percent", [80, 85])
def test_linked(percent, monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(ND, "PIVOTS", 3)
    for t in range(150):
        base = [rng.choice(1000, rng.integers(1, 30), replace=False) for _ in range(3)]
        sets = []
        for _ in range(rng.integers(2, 40)):
            b = base[rng.integers(3)].copy()
            change = rng.random(len(b)) < rng.choice([0.02, 0.05, 0.1])
            b[change] = rng.integers(1000, 2000, change.sum())
            sets.append(np.unique(b.astype(np.uint64)))
        want = _linked_by_pairs(sets, percent)
        family = np.zeros(len(sets), np.int32)
        forest = ND.Forest(len(sets))
        if t % 3 == 0:  # part of the largest component is known beforehand
            family[(np.array(want) == np.bincount(want).argmax()) & (rng.random(len(sets)) < 0.5)] = 1
            known = np.flatnonzero(family).tolist()
            for i in known:
                forest.join(known[0], i)
        for x, y in ND.linked(sets, percent, family):
            forest.join(x, y)
        assert [forest.root(i) for i in range(len(sets))] == want


def test_template_documents_take_little_memory():
    """Thousands of short documents that differ in one shingle: memory follows the shingles, not the pairs."""
    import tracemalloc

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    sets = []
    for _ in range(20_000):
        b = base.copy()
        b[rng.integers(40)] = rng.integers(0, 1 << 62)
        sets.append(np.unique(b))
    tracemalloc.start()
    edges = ND.linked(sets, 85)
    assert len(edges) == 19_999 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def _spans(rng):
    group, n, place, spans = [], [], [], []
    for g in range(rng.integers(1, 6)):
        gram, base = rng.integers(0, 256, 20).astype(np.uint8).tobytes(), rng.integers(0, 2, 400).astype(np.uint8).tobytes()
        for _ in range(rng.integers(1, 12)):
            p = int(rng.integers(0, 181))
            sides = [bytearray(base[200 - p : 200]), bytearray(base[200 : 200 + int(rng.integers(180 - p, 181))])]
            for x in sides:
                if len(x) and rng.random() < 0.6:
                    x[rng.integers(len(x))] = int(rng.integers(0, 3))
            group.append(g * 77 - 100)
            n.append(int(rng.choice([1, 1, 2])))
            place.append(p)
            spans.append(bytes(sides[0]) + gram + bytes(sides[1]))
    return np.array(group), np.array(n), np.array(place), spans


def _repeated_by_count(group, n, place, spans, low, high):
    met = collections.Counter((g, p - w, s[w : w + 200]) for g, p, s in zip(group, place, spans, strict=True) for w in range(len(s) - 199))
    return [[w for w in range(len(s) - 199) if k == 1 and low <= p - w <= high and met[g, p - w, s[w : w + 200]] > 1] for g, k, p, s in zip(group, n, place, spans, strict=True)]


def test_repeated_windows(monkeypatch):
    rng = np.random.default_rng(1)
    cases = [_spans(rng) for _ in range(80)]
    for group, n, place, spans in cases:
        for low, high in ((0, 180), (91, 180), (50, 55)):
            got = SU.repeated_windows(group, n, place, spans, np.full(len(n), low), np.full(len(n), high))
            assert [x.tolist() for x in got] == _repeated_by_count(group, n, place, spans, low, high)
    # The order of the array decides: in the order of the input windows are missed.
    monkeypatch.setattr(SU, "suffix_array", lambda s: np.arange(len(s)))
    assert any([x.tolist() for x in SU.repeated_windows(*case)] != _repeated_by_count(*case, 0, 180) for case in cases)


def test_owners_of_long_texts():
    rng = np.random.default_rng(2)
    raws = [rng.integers(0, 3, rng.integers(0, 3000)).astype(np.uint8).tobytes() for _ in range(40)]
    found = []
    for piece in (SU.PIECE, 700):
        rows = zip(*(c.tolist() for c in SU.owners(raws, piece)), strict=True)
        found.append({(t, w, g, p) for t, g, _, f, last, p in rows for w in range(f, last + 1)})
    assert found[0] == found[1] and len(found[0]) == sum(max(0, len(x) - 199) for x in raws)


def test_forgotten_words_are_learnt_again(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"word{k}" for k in rng.integers(0, 60, 30)).encode() for _ in range(40)]
    want = PA.WordIds(PA.tokenizer_path()).ids(texts)
    monkeypatch.setattr(PA, "REMEMBERED", 20)
    coder = PA.WordIds(PA.tokenizer_path())
    got = [coder.ids([t])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and len(coder.known) < 60
