"""Lineages of merges against a walk, and figures of merged records against those of the reads pooled by hand."""

import random

import pytest

from ampliform.operators import lineage

RATES = {"non-hp-sub": 0.004, "non-hp-indel": 0.003} | {f"hp-l{k}": 0.01 * k for k in range(2, 6)}


def test_contributors(spark):
    rng = random.Random(3)
    parts = {f"m{i}": {f"m{j}" for j in range(i) if rng.random() < 0.2} | {f"c{rng.randrange(30)}" for _ in range(2)} for i in range(12)}
    parts |= {f"d{i}": {f"d{i + 1}"} for i in range(20)}

    def leaves(x):
        return set().union(*(leaves(p) for p in parts[x])) if x in parts else {x}

    merges = spark.createDataFrame([(r, p) for r, ps in parts.items() for p in ps], "name string, part string")
    records = spark.createDataFrame([(r,) for r in [*parts, "c1", "other"]], "name string")
    got = {}
    for r in lineage.contributors(records, merges, "name", "part").collect():
        got.setdefault(r.name, set()).add(r.part)
    assert got == {r: leaves(r) for r in [*parts, "c1", "other"]}
    with pytest.raises(ValueError, match="circle"):
        lineage.contributors(records, spark.createDataFrame([("a", "b"), ("b", "a")], "name string, part string"), "name", "part")


def test_figures(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("AACGT") for _ in range(60))
    reads = []
    for c in range(4):
        for i in range(6):
            k = rng.randrange(60)
            reads.append((f"c{c}", 100 * c + i, base[:k] + rng.choice(("", "A", "CG")) + base[k + 1 :]))
    df = spark.createDataFrame([*reads, ("c1", 0, reads[0][2])], "part string, read long, seq string")  # a read of two clusters
    merges = spark.createDataFrame([("m", "n"), ("m", "c0"), ("n", "c1"), ("n", "c2")], "name string, part string")
    records = spark.createDataFrame([("m",), ("n",), ("c3",), ("gone",)], "name string")
    got = {r.name: r for r in lineage.refreshed(records, merges, df, "name", "part", "read", "seq", RATES).collect()}
    pool = {"m": ("c0", "c1", "c2"), "n": ("c1", "c2"), "c3": ("c3",)}
    by_hand = [(n, r.read, r.seq) for n, cs in pool.items() for r in df.where(df.part.isin(*cs)).dropDuplicates(["read"]).collect()]
    none = spark.createDataFrame([], "name string, part string")
    hand = spark.createDataFrame(by_hand, "part string, read long, seq string")
    want = {r.name: r for r in lineage.refreshed(records, none, hand, "name", "part", "read", "seq", RATES).collect()}
    assert got == want
    assert [got[n].n_reads for n in ("m", "n", "c3", "gone")] == [18, 13, 6, 0]
    assert got["gone"].rid is None
    assert 0.9 < got["m"].rid < 1
    assert got["m"].err_factor > 0
