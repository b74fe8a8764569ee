import random

import numpy as np
import pytest

from setweave.llm import components, minhash, near_dedup, shingles

from ..conftest import rows
from .conftest import edited, make, prose


def brute(pairs):
    """Component by doc_id, from all pairs of full sets of words."""
    sets = {}
    for i, t in pairs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return [(i, len(sets[i]), root(i), root(i) == i) for i in ids]


def corpus():
    out = [prose(s, 120) for s in range(12)]
    out += [edited(out[s], 100 * s + k, k % 9) for s in range(6) for k in range(14)]  # up to 9 edits of 120 words: some linked, some not
    out += [out[3]] * 5 + ["A b c", "a B  c", "a b c d", "", None]
    random.Random(4).shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("block", [4, 1024])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    pairs = corpus()
    assert rows(near_dedup.near_duplicates(make(spark, pairs))) == brute(pairs)


def test_open_buckets_are_closed_without_pivots(spark, monkeypatch):
    """A chain whose neighbours alone are linked, so that pivots don't reach all of it."""
    base = prose(5, 400)
    chain, t = [], base.split(" ")
    for k in range(12):
        chain.append(" ".join(t))
        for j in range(12):
            t[(k * 12 + j) * 2 % 400] = f"c{k}x{j}"
    pairs = list(enumerate(chain))
    assert rows(near_dedup.near_duplicates(make(spark, pairs))) == brute(pairs)


def test_rules(spark, odd):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(odd).collect()}
    assert (got[0]["n_shingles"], got[0]["component_id"], got[1]["kept"], got[2]["kept"]) == (0, 0, True, True)
    assert got[4]["component_id"] == 3 and got[6]["component_id"] == 5 and not got[6]["kept"]
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert got[2**62]["component_id"] == -5
    kept = near_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [0, 1, 2, 3, 5, None, None, 7, 8, 9, 10, -5]))


def test_sets_in_bulk_are_the_sets():
    texts = ["a b c d e f", None, "a b", "", prose(1, 300), "a b c d e", "A  b\tC d e f"]
    h, owner = shingles.shingle_sets([shingles.words_of(t) for t in texts], shingles.WordHashes())
    for i, t in enumerate(texts):
        assert (h[owner == i] == shingles.shingle_set(shingles.words_of(t), shingles.WordHashes())).all()
    m = shingles.Minima(3, 2, 4)
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    got = m(h, start)
    with np.errstate(over="ignore"):
        want = [[((h[owner == o] * a + b) >> np.uint64(32)).min() for a, b in zip(m.a, m.b, strict=True)] for o in owner[start]]
    assert (got == np.array(want)).all() and m.band_keys(got).shape == (len(start), 3)


def test_words_split_at_ascii_space_only():
    assert shingles.words_of("A b C\x1cd \x0b e") == ["a b".encode(), b"c\x1cd", b"e"]
    assert shingles.words_of("É") == ["É".encode()]


def test_components(spark):
    g = random.Random(1)
    links = [(g.randrange(80), g.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)] + [(500, i) for i in range(600, 640)]
    parent = {i: i for e in links for i in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    got = dict(rows(components.components(spark.createDataFrame(links, "a long, b long"))))
    assert got == {i: root(i) for e in links if e[0] != e[1] for i in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
