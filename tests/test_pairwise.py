"""Alignment, recombinants and significance against brute force."""

import math
import random

import pandas as pd

from ampliform.operators import pairwise, runs, significance


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_alignment_is_shortest():
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b = [make(rng.randrange(0, 30)) for _ in range(200)], [make(rng.randrange(0, 30)) for _ in range(200)]
    for (p, q), x, y in zip(pairwise.align(a, b), a, b, strict=True):
        assert p.replace("-", "") == x and q.replace("-", "") == y
        assert sum(u != v for u, v in zip(p, q, strict=True)) == distance(x, y)


def test_tags():
    assert pairwise.tags("ACG-TTT", "ACGATTT") == ["non-hp-indel"]
    assert pairwise.tags("AC-GTTT", "ACCGTTT") == ["hp-l2-C-del1"]
    assert pairwise.tags("ACCCGTT", "AC-CGTT") == ["hp-l2-C-ins1"]
    assert pairwise.tags("ATG", "ACG") == ["non-hp-sub"]


def test_runs_are_free():
    assert pairwise.run_free_distance("AAAAAA-C", "AAAAAAAC")[1]
    assert not pairwise.run_free_distance("AA-C", "AAAC")[1]


def test_infix_distance(spark):
    text = ["TTACGTTT", "TTACTTTT", "", "ACGT"]
    f = pairwise.infix_distance.func
    assert f(pd.Series(["ACGT"] * 4), pd.Series(text)).tolist() == [0, 1, 4, 0]
    assert f(pd.Series(["ACRT"]), pd.Series(["TTACGTTT"])).tolist() == [0]


def test_tail_and_critical_rate():
    for m, n, q in ((3, 50, 0.01), (1, 5, 0.3), (20, 40, 0.4)):
        want = sum(math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(m, n + 1))
        assert abs(significance.log_tail(m, n, math.log(q)) - math.log(want)) < 1e-9
    q = significance.log_critical(100, 10, 600)
    assert abs(significance.log_tail(10, 100, q) - math.log(1e-5 / 600)) < 1e-6
    assert significance.log_critical(5, 0, 10) is None


def test_chimera(spark):
    rng = random.Random(2)
    a = "".join(rng.choice("ACGT") for _ in range(100))
    b = "".join(rng.choice("ACGT".replace(c, "")) if i % 10 == 0 else c for i, c in enumerate(a))
    df = spark.createDataFrame([("g", 1, 100, a), ("g", 2, 50, b), ("g", 3, 10, a[:50] + b[50:]), ("g", 4, 5, a)], "g string, name long, size long, row string")
    got = runs.chimeras(df, "g", "name", "size", "row").collect()
    assert [(r.candidate, r.a, r.b, r.sites, r.mismatches) for r in got] == [(3, 1, 2, 10, 0)]
