"""Hard negatives against a plain version, with nulls, odd vectors, ties, repeated rows, several waves and empty tables."""

import math

import numpy as np
import pytest

from ampliform.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rank int, score double"


def rows(seed=1, n=500, dim=12, spread=0.4):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((10, dim))
    out = []
    for i in range(n):
        k = int(rng.integers(10))
        x = centre[k] + spread * rng.standard_normal(dim)
        out.append((i * 5, [float(np.float32(c)) for c in x / np.linalg.norm(x) * rng.uniform(0.5, 2)], k))
    common = out[3][1]
    out += [(5000 + i, common, i % 2) for i in range(150)]  # a common vector: ties in plenty
    out += [(9000, None, 1), (9100, [1.0, None], 1), (9200, [math.nan] * dim, 1), (9300, [math.inf] * dim, 2), (9400, common, None), (9500, [0.0] * dim, 3), (9600, [], 4), (9700, [1.0, 0.5], 4), (None, common, 1), (9800, [1e30] * dim, 1)]
    out += out[:3] + [(0, common, 7)]
    return [(*r, "v", 9, 0.5) for r in out]


def plain(rows, anchor=lambda i: i % 100 == 0, k=5, m=10):
    seen = {}
    for i, x, label, *_ in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) or abs(c) >= 2**16 for c in x):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        v = tuple(math.floor(256 * c) for c in x)
        seen[i, label, v] = None
    all_ = list(seen)
    dim = max((len(r[2]) for r in all_), default=1)
    mat = np.zeros((len(all_), dim), np.int64)
    for a, r in enumerate(all_):
        mat[a, : len(r[2])] = r[2]
    big = lambda i: 1 << 60 if i is None else i
    out = []
    for a, (i, label, _) in enumerate(all_):
        if i is None or not anchor(i):
            continue
        s = mat @ mat[a]
        order = sorted((b for b in range(len(all_)) if b != a), key=lambda b: (-s[b], big(all_[b][0])))
        for p in [b for b in order if all_[b][1] == label][:k]:
            ok = [b for b in order if all_[b][1] != label and 30 * s[p] <= 100 * s[b] <= 90 * s[p]][:m]
            out += [(i, all_[p][0], r + 1, all_[b][0], int(s[p]), int(s[b])) for r, b in enumerate(ok)]
    return out


def key(rows):
    return sorted(tuple(-1 if c is None else c for c in r) for r in rows)


@pytest.mark.parametrize("wave", [None, 3])
def test_all_rows(spark, monkeypatch, wave):
    if wave:
        monkeypatch.setattr(negatives, "WAVE", wave)
    data = rows()
    got = negatives.hard_negatives(spark.createDataFrame(data, SCHEMA).repartition(6))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert key(map(tuple, got.collect())) == key(plain(data))


def test_other_limits(spark):
    data = rows(4, 120, 5)
    got = negatives.hard_negatives(spark.createDataFrame(data, SCHEMA), negatives.F.col("vec_id") % 35 == 0, positives=2, negatives=3)
    assert key(map(tuple, got.collect())) == key(plain(data, lambda i: i % 35 == 0, 2, 3))


def test_few_rows(spark):
    for data in ([], rows()[:1], rows()[-5:], [(100, [1.0], 1, "v", 9, 0.5), (200, [1.0], 1, "v", 9, 0.5)]):
        got = negatives.hard_negatives(spark.createDataFrame(data, SCHEMA))
        assert key(map(tuple, got.collect())) == key(plain(data))


def test_ranges_rule_out():
    """Near copies: few rows are scored, and none that counts is lost."""
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((60, 16))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    v = np.floor(256 * (np.repeat(centre, 30, axis=0) + 0.005 * rng.standard_normal((1800, 16))))
    ids = np.arange(1800)
    length = np.sqrt((v * v).sum(axis=1))
    block = negatives.Block(v, ids, ids, np.zeros(1800, np.int64), length.max(), length.min())
    own = np.arange(0, 1800, 100)
    floor = np.array([np.sort(v @ v[i])[::-1][8] for i in own])
    q = negatives.Queries(v[own], own, np.zeros(len(own), np.int64), np.arange(len(own)), True, np.full(len(own), -np.inf), np.full(len(own), np.inf), 5)
    state = negatives.State(q, floor)
    state.look(block)
    assert state.scored < state.looked / 4
    for k, i in enumerate(own):
        s = v @ v[i]
        want = sorted((b for b in range(1800) if b != i), key=lambda b: (-s[b], b))[:5]
        got = state.rows[state.rows[:, 0] == k]
        assert got[np.lexsort((got[:, 2], got[:, 1]))][:, 2].tolist() == want


def test_feasible_values():
    rng = np.random.default_rng(5)
    p, q = (x / np.linalg.norm(x, axis=1)[:, None] for x in rng.standard_normal((2, 5000, 3)))
    cosine = (p * q).sum(axis=1)
    for f in range(3):
        low, high = negatives.feasible(q[:, f], cosine)
        assert (p[:, f] >= low).all()
        assert (p[:, f] <= high).all()
