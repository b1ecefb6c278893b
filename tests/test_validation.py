"""Critical rates of arrays against sums of terms; variants against larger peers in plain Python."""

import math
import random

import numpy as np
import pytest

from ampliform.operators import pairwise, significance, validation

MODEL = {"non-hp-sub": 0.004, "non-hp-indel": 0.003, "hp-l2": 0.01, "hp-l3": 0.02}


def test_tails():
    rng = random.Random(3)
    cases = [(1, 1, -3.0), (5, 5, -0.1), (1, 400, -9.0), (400, 400, -0.01)]
    for _ in range(300):
        n = rng.randrange(1, 800)
        cases.append((rng.randrange(1, n + 1), n, -rng.choice((1e-6, 0.01, 0.5, 3, 20, 300)) * rng.random()))
    got = significance.log_tails(*(np.array(c) for c in zip(*cases, strict=True)))
    for (m, n, q), x in zip(cases, got, strict=True):
        want = significance.log_tail(m, n, q)
        assert x == pytest.approx(want, rel=1e-7, abs=1e-9), (m, n, q)
    x = np.array([0.5, 1, 1.5, 2, 7.9, 8, 100, 1e6])
    assert significance._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


def test_critical_rates():
    rng = random.Random(5)
    cases = [(10, 0, 5, 1), (10, 11, 5, 1), (10, 3, 0, 1), (10, 3, 2, 3), (4, 4, 10, 1), (10**6, 50, 800, 1)]
    cases += [(n := rng.randrange(1, 400), rng.randrange(1, n + 1), rng.randrange(20, 900), rng.randrange(1, 9)) for _ in range(80)]
    got = significance.log_criticals(*(np.array(c) for c in zip(*cases, strict=True)))
    for c, x in zip(cases, got, strict=True):
        if c[0] > 10**5:
            assert significance.log_tails([50], [10**6], [x])[0] == pytest.approx(math.log(1e-5 / 800), abs=1e-6)
            continue
        want = significance.log_critical(*c)
        assert math.isnan(x) if want is None else x == pytest.approx(want, rel=1e-6)


def plain(rows):
    """rows: (name, seq, size) of a group. Factor and deciding peer of each."""
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    total, out = sum(r[2] for r in rows), {}
    runs = lambda s: 1 + sum(a != b for a, b in zip(s, s[1:], strict=False))
    for i, (name, seq, size) in enumerate(order):
        best = None
        for peer, other, _ in order[:i] if seq else []:
            if not other:
                continue
            tags = pairwise.tags(*next(pairwise.align([seq], [other])))
            rates = [MODEL[k] for t in tags if (k := "-".join(t.split("-")[:2]) if t.startswith("hp-l") else t) in MODEL]
            if not rates:
                continue
            log_q = significance.log_critical(total, size, runs(other if len(other) >= len(seq) else seq), len(rates))
            if log_q is None:
                continue
            f = math.inf if log_q == math.inf else math.exp((log_q - sum(map(math.log, rates))) / len(rates))
            if best is None or round(f, 6) < round(best[0], 6):
                best = (f, peer, len(rates))
        out[name] = (None, None, None) if i == 0 else (0.0, None, None) if not seq else best or (None, None, None)
    return out


def test_validated(spark):
    rng = random.Random(11)
    data, want = [], {}
    for g in range(6):
        base = "".join(rng.choice("AACGT") for _ in range(70))
        rows = [(100 * g, base, 400)]
        for i in range(1, (1, 3, 6, 6, 9, 4)[g]):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(70)
                t[k] = rng.choice(("", "A", "C", "GG", t[k] + t[k]))
            rows.append((100 * g + i, "".join(t) if rng.random() < 0.9 else None, rng.randrange(1, 60)))
        data += [(g, *r) for r in rows]
        want |= plain([(n, s or "", z) for n, s, z in rows])
    df = spark.createDataFrame(data, "g long, name long, seq string, size long")
    got = {r.name: r for r in validation.validated(df, ["g"], "name", "seq", "size", MODEL).collect()}
    assert got.keys() == want.keys()
    for n, (f, peer, k) in want.items():
        r = got[n]
        assert (r.cer_factor is None) == (f is None)
        if f is not None:
            assert r.cer_factor == pytest.approx(f, rel=1e-5)
        if peer is not None:
            assert (r.peer, r.k) == (peer, k)
    # blocked by pieces, each meets fewer peers: factors are never lower
    few = {r.name: r.cer_factor for r in validation.validated(df, ["g"], "name", "seq", "size", MODEL, dense=3, peers=2).collect()}
    for n, (f, _, _) in want.items():
        if f is not None and few[n] is not None:
            assert few[n] >= f * (1 - 1e-6)
    assert validation.validated(df.where("false"), ["g"], "name", "seq", "size", MODEL).count() == 0
