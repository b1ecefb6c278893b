"""The most similar larger variant against all pairs, and without comparing them all."""

import random

import numpy as np
import pytest

from ampliform.operators import curation, parentage


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def changed(rnd, text):
    t = list(text)
    for _ in range(rnd.choice((0, 1, 1, 2, 3))):
        at = rnd.randrange(len(t))
        t[at : at + 1] = rnd.choice(([], [rnd.choice("ACGT")], [t[at], rnd.choice("ACGT")]))
    return "".join(t)


def expected(group):
    ranked = sorted(group, key=lambda r: (-r[2], r[1]))
    out = {}
    for g, o, z, s in ranked[1:]:
        best = None
        for p in ranked:
            if p[2] > z or p is ranked[0]:
                e = distance(s, p[3])
                i = 1 - e / max(len(s), len(p[3])) if max(len(s), len(p[3])) else 1.0
                best = max(best, (round(i, 9), p[2], -p[1], e)) if best else (round(i, 9), p[2], -p[1], e)
        out[o] = (-best[2], best[1], best[3])
    return out


@pytest.mark.parametrize("slice_", [400, 1_500_000])
def test_parents_are_those_of_all_pairs(spark, monkeypatch, slice_):
    monkeypatch.setattr(parentage, "SLICE", slice_)
    rnd = random.Random(5)
    rows = []
    for g in range(4):
        centres = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (70, 40, 66, 9)]
        for _ in range(25):
            rows.append((g, len(rows), rnd.randrange(1, 12), changed(rnd, rnd.choice(centres))))
    rows += [(9, 1000, 5, ""), (9, 1001, 5, ""), (9, 1002, 3, "ACG")]
    want = {}
    for g in {r[0] for r in rows}:
        want |= expected([r for r in rows if r[0] == g])
    df = spark.createDataFrame(rows, "g int, ordinal long, size long, seq string")
    got = {r.ordinal: (r.parent, r.parent_size, r.edits) for r in curation.parents(df, ["g"]).collect()}
    assert got == want


def test_missing_sequences_and_sizes_have_the_anchor(spark):
    rows = [(1, 1, 9, "ACGT"), (1, 2, 8, "ACGA"), (1, 3, None, "ACGA"), (1, 4, 2, None), (2, 5, 4, None), (2, 6, 3, "AC"), (None, 7, 1, "A")]
    df = spark.createDataFrame(rows, "g int, ordinal long, size long, seq string")
    got = {r.ordinal: (r.parent, r.identity, r.edits) for r in curation.parents(df, ["g"]).collect()}
    assert got == {2: (1, 0.75, 1), 3: (1, 0.75, 1), 4: (1, None, None), 6: (5, None, None)}


def test_pairs_tried_do_not_grow_with_the_square_of_a_group(monkeypatch):
    tried = []
    edits = parentage.Texts.edits
    monkeypatch.setattr(parentage.Texts, "edits", lambda x, a, b: (tried.append(len(a)), edits(x, a, b))[1])
    rnd = random.Random(3)
    centres = ["".join(rnd.choice("ACGT") for _ in range(96)) for _ in range(8)]
    texts = list(dict.fromkeys([*centres, *(changed(rnd, rnd.choice(centres)) for _ in range(2000))]))
    n = len(texts)
    parentage.nearest_larger(texts, np.arange(n, 0, -1).astype(float), np.arange(n) == 0, np.zeros(n, int), np.arange(n), np.arange(n))
    assert sum(tried) < 40 * n < n * n / 20


def all_pairs(texts, size):
    """(row, edits) of the best larger row of each, over all pairs; rows in order, the first has none."""
    x, n = parentage.Texts(texts), len(texts)
    e = x.edits(np.repeat(np.arange(n), n), np.tile(np.arange(n), n)).reshape(n, n)
    longer = np.maximum(np.maximum(x.size[:, None], x.size[None, :]), 1)
    may = np.where((size[None, :] > size[:, None]) | (np.arange(n) == 0)[None, :], np.round(1 - e / longer, 9), -1.0)
    best = may.argmax(axis=1)
    best[0], cost = -1, e[np.arange(n), best]
    return best.tolist(), [-1, *cost[1:].tolist()]


def test_clusters_without_a_larger_neighbour_are_not_compared_one_by_one(monkeypatch):
    tried = []
    edits = parentage.Texts.edits
    monkeypatch.setattr(parentage.Texts, "edits", lambda x, a, b: (tried.append(len(a)), edits(x, a, b))[1])
    rnd = random.Random(11)
    centres = ["".join(rnd.choice("ACGT") for _ in range(96)) for _ in range(12)]
    texts = list(dict.fromkeys(t for c in centres for t in (c, *(changed(rnd, c) for _ in range(60)))))
    size = np.array([100.0 - min(k for k, c in enumerate(centres) if distance(c, t) < 12) for t in texts])
    n = len(texts)
    best, cost = parentage.nearest_larger(texts, size, np.arange(n) == 0, np.zeros(n, int), np.arange(n), np.arange(n))
    assert sum(tried) < (size[:, None] < size[None, :]).sum() / 4
    assert (best.tolist(), cost.tolist()) == all_pairs(texts, size)


@pytest.mark.parametrize("seed", range(4))
def test_single_edits_of_short_texts(seed):
    rnd = random.Random(seed)
    texts = list({"".join(rnd.choice("AC" if seed % 2 else "ACGTé") for _ in range(rnd.randrange(0, 7))) for _ in range(150)})
    rnd.shuffle(texts)
    n = len(texts)
    size = np.array(sorted((rnd.randrange(30) for _ in texts), reverse=True), float)
    best, cost = parentage.nearest_larger(texts, size, np.arange(n) == 0, np.zeros(n, int), np.arange(n), np.arange(n))
    assert (best.tolist(), cost.tolist()) == all_pairs(texts, size)
