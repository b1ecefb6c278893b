"""Merging against plain loops: clusters by runs one after another, groups one contraction at a time, overlaps by a plain matrix."""

import random
import re

import pytest

from ampliform.functions import sequence
from ampliform.operators import merging, overlap

RUN = re.compile("A+|C+|G+|T+")


def greedy(rows, least):
    """rows: (cluster, size, seq). Each joins the first class that it's equivalent to."""
    heads, into = [], {}
    for c, _, s in sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[1], r[0])):
        runs = [(x[0], len(x)) for x in RUN.findall(s)]
        for h, other in heads:
            if [b for b, _ in runs] == [b for b, _ in other] and all(x == y or least is not None and max(x, y) >= least for (_, x), (_, y) in zip(runs, other, strict=True)):
                into[c] = h
                break
        else:
            heads.append((c, runs))
            into[c] = c
    return into | {c: c for c, _, s in rows if s is None}


@pytest.mark.parametrize("least", [None, 1, 3])
def test_equivalence_classes(spark, least):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(5):
        own = []
        for i in range(40):
            seq = "".join(b * rng.randrange(1, 6) for b in ("A", "C", rng.choice("GT"), "A"))
            own.append((100 * g + i, rng.randrange(1, 9), seq if rng.random() < 0.95 else None))
        rows += [(g, *r) for r in own]
        want |= greedy(own, least)
    df = spark.createDataFrame(rows, "g long, cluster long, size long, seq string")
    got = {r.cluster: r["into"] for r in merging.equivalence_classes(df, "g", "cluster", "seq", "size", least).collect()}
    assert got == want


def test_contraction(spark):
    rng = random.Random(6)
    variants, links, want = [], [], {}
    for s in range(12):
        groups = {g: [rng.randrange(1, 12) for _ in range(rng.randrange(1, 4))] for g in range(9)}
        pairs = {(a, b) for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.15}
        variants += [(s, g, x) for g, sizes in groups.items() for x in sizes]
        links += [(s, a, b) for a, b in pairs]
        held = {g: {g} for g in groups}
        size = {g: max(x) for g, x in groups.items()}
        while True:  # the first pair in order of anchors that links contracts, the larger takes the smaller in
            order = sorted(held, key=lambda g: (-max(size[x] for x in held[g]), g))
            pair = next(((a, b) for i, a in enumerate(order) for b in order[i + 1 :] if any((min(x, y), max(x, y)) in pairs for x in held[a] for y in held[b])), None)
            if pair is None:
                break
            held[pair[0]] |= held.pop(pair[1])
        want |= {(s, x): g for g, xs in held.items() for x in xs}
    got = merging.contracted(spark.createDataFrame(variants, "s long, g long, size long"), spark.createDataFrame(links, "s long, a long, b long"), "s", "g", "size")
    assert {(r.s, r.g): r["into"] for r in got.collect()} == want
    none = spark.createDataFrame([], "s long, a long, b long")
    assert all(r.g == r["into"] for r in merging.contracted(spark.createDataFrame(variants, "s long, g long, size long"), none, "s", "g", "size").collect())


def plain_score(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = max(d[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), d[i - 1][j] - 1, d[i][j - 1] - 1)
    return max([r[len(b)] for r in d] + d[len(a)])


def test_overlaps():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pairs = [("", ""), ("A", ""), ("ACGT", "ACGT")]
    for _ in range(60):
        a = text(rng.randrange(0, 30))
        b = a[rng.randrange(0, 10) :] + text(rng.randrange(0, 9)) if rng.random() < 0.6 else text(rng.randrange(0, 30))
        pairs.append((a, b))
    for (a, b), (p, q, n, m) in zip(pairs, overlap.overlaps([x for x, _ in pairs], [y for _, y in pairs]), strict=True):
        x, y = p.replace("-", ""), q.replace("-", "")
        assert (len(x), len(y)) == (n, m)
        assert x in a
        assert y in b
        assert sum(1 if u == v else -1 for u, v in zip(p, q, strict=True)) == plain_score(a, b)


def test_distances():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    one, two, three = text(150), text(100), text(150)
    full = one + two + three
    d = lambda a, b, need=80, least=1: overlap.overlap_distances([a], [b], need, least)[0]
    assert d(full, full) == 0
    assert d(full, two) == 0  # contained
    assert d(full, one + two) == d(two + three, full) == 0  # prefix and suffix
    assert d(one + two, two + three) == 0  # they share the middle
    assert d(one + two, two + three, 120) > 0.3  # too little of it
    assert d(full, full[100:160]) == 0  # shorter than what is asked, but whole
    assert d("", full) == d(full, "") == 1
    changed = two[:50] + ("A" if two[50] != "A" else "C") + two[51:]
    assert d(full, changed) == pytest.approx(0.01)
    long = "ACGT" * 10 + "A" * 8 + "CGTC" * 10
    assert d(long, long.replace("A" * 8, "A" * 6), 40) == 0
    assert d(long, long.replace("A" * 8, "A" * 6), 40, 9) == pytest.approx(2 / 88)
    assert overlap.adjusted_distances([full], [full[:220]], 1)[0] > 0.3  # too little of the longer one
    assert overlap.adjusted_distances(["ACGTY"], ["ACGTC"], 1) == [0.0]


def test_primers(spark):
    rows = [(["a", "b"], ["b", "a"], True), (["a"], ["b"], False), (None, ["a"], True), ([], ["a"], True), (["a", "a"], ["a"], True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p array<string>, q array<string>, same boolean")
    assert all(r.same == r.got for r in df.withColumn("got", sequence.same_primers(df.p, df.q)).collect())


def test_summaries():
    say = lambda a, b: overlap.summary(*next(overlap.align([a], [b])))
    assert say("ACGTACGTAA", "ACGAACGTAA") == "1 substitution"
    assert say("ACGTACGTCC", "ACGTACTTTGTCC") in ("1 short (<= 3nt) indel", "3 single-nt indels", "1 single-nt indel, 1 short (<= 3nt) indel")
    assert say("ACGY", "ACGT") == "identical sequences (IUPAC-compatible)"
