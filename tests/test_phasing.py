"""Phasing against a plain recursion on reads without insertions, and on nested haplotypes with errors, at any depth."""

import random
from collections import Counter

from ampliform.operators import columns, phasing

TURN = str.maketrans("ACGT", "CATG")


def plain(reads, count, frequency, sample=None, path=()):
    """reads: (quality, read, text) of one length, without runs. Leaves and deferred reads by path."""
    if len(reads) < 2 * count:
        return {"-".join(path): {r for _, r, _ in reads}}, {}
    order = sorted(reads, key=lambda x: (-x[0], x[1]))
    some = order[:sample] if sample else order

    def passes(rows, i, floor_first):
        n = Counter(t[i] for *_, t in rows)
        ranked = sorted(n, key=lambda b: (-n[b], "ACGT".index(b)))
        return {b for k, b in enumerate(ranked) if n[b] >= count and n[b] >= frequency * len(rows) and (k or not floor_first)}

    width = len(reads[0][2])
    variants = [i for i in range(width) if passes(order, i, True) or passes(some, i, True)]
    best = None
    for i in variants:
        good = passes(order, i, False) | passes(some, i, False)
        if len(good) < 2:
            continue
        total = err = 0
        for b in good:
            rows = [t for *_, t in reads if t[i] == b]
            e = sum(1 - max(Counter(t[j] for t in rows).values()) / len(rows) for j in variants) / len(variants)
            err, total = err + e * len(rows), total + len(rows)
        if best is None or round(err / total, 9) < best[0]:
            best = (round(err / total, 9), i, good)
    if best is None:
        return {"-".join(path): {r for _, r, _ in reads}}, {}
    _, i, good = best
    leaves, deferred = {}, {}
    if gone := {r for _, r, t in reads if t[i] not in good}:
        deferred["-".join(path)] = gone
    for b in good:
        more, late = plain([x for x in reads if x[2][i] == b], count, frequency, sample, (*path, b))
        leaves |= more
        deferred |= late
    return leaves, deferred


def nested(rng, depth, width=40, halved=False):
    """Haplotypes that branch off one another, without runs, and reads with replaced letters; each of half the size of the one before."""
    base = "".join(rng.choice("AC") + rng.choice("GT") for _ in range(width // 2))
    haps, now = [base], base
    for k in range(depth):
        i = 2 + (width - 4) * k // depth
        now = now[:i] + now[i].translate(TURN) + now[i + 1 :]
        haps.append(now)
    rows = []
    for k, h in enumerate(haps):
        for _ in range(4 << (depth - k) if halved else rng.randrange(4, 9)):
            t = list(h)
            if rng.random() < 0.5:
                i = rng.randrange(width)
                t[i] = t[i].translate(TURN)
            rows.append("".join(t))
    for _ in range(3):  # an allele too rare to pass, at a place where others split
        t = list(rng.choice(haps))
        t[2] = "T" if t[2] in "AC" else "A"
        rows.append("".join(t))
    return rows


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.g, {}).setdefault(r.path, set()).add(r.read)
    return out


def test_nested_haplotypes(spark):
    rng = random.Random(12)
    data, want_leaves, want_late = [], {}, {}
    for g, depth in enumerate((0, 4, 3)):
        rows = [(round(rng.uniform(5, 30), 3), 1000 * g + i, t) for i, t in enumerate(nested(rng, depth, halved=depth == 3))]
        data += [(g, r, t, q) for q, r, t in rows]
        leaves, late = plain(rows, 4, 0.005, 12)
        want_leaves[g] = leaves
        if late:
            want_late[g] = late
    df = spark.createDataFrame([*data, (None, 1, "ACGT", 1.0)], "g long, read long, seq string, q double")
    leaves, late = phasing.phased(df, "g", "read", "seq", 4, 0.005, "q", 12)
    assert grouped(leaves) == want_leaves
    assert grouped(late) == want_late
    assert max(p.count("-") for p in want_leaves[2]) >= 2
    # no read is lost or doubled
    assert sorted(r.read for r in leaves.union(late).collect()) == sorted(r for _, r, _, _ in data)


def test_splits_of_one_alignment(spark):
    """The same recursion on rows that are aligned, deep: each haplotype half as frequent as the one before."""
    rng = random.Random(5)
    data, want, late = [], {}, {}
    for g, depth in enumerate((4, 1)):
        rows = [(0, 1000 * g + i, t) for i, t in enumerate(nested(rng, depth, halved=True))]
        data += [(g, r, t) for _, r, t in rows]
        leaves, gone = plain(rows, 4, 0.005)
        want[g], late[g] = {frozenset(x) for x in leaves.values()}, {r for x in gone.values() for r in x}
    got, gone = {}, {0: set(), 1: set()}
    for r in columns.recursive_splits(spark.createDataFrame(data, "g long, read long, row string"), "g", "read", "row", 4, 0.005).collect():
        gone[r.g].add(r.read) if r.deferred else got.setdefault(r.g, {}).setdefault(r.path, set()).add(r.read)
    assert {g: {frozenset(x) for x in parts.values()} for g, parts in got.items()} == want
    assert gone == late


def test_runs_do_not_split(spark):
    core = "ACGTTGCAGCTTACG" + "A" * 7 + "GATCCATGACGTCA"
    data = [(1, i, core if i % 2 else core.replace("A" * 7, "A" * 6)) for i in range(20)]
    data += [(2, 100 + i, core if i % 2 else core.replace("GAT", "GT")) for i in range(20)]
    data += [(3, 200, None), (3, 201, "")]
    leaves, late = phasing.phased(spark.createDataFrame(data, "g long, read long, seq string"), "g", "read", "seq", 3, 0.1)
    got = grouped(leaves)
    assert got[1] == {"": set(range(20))}
    assert sorted(map(sorted, got[2].values())) == [list(range(100, 120, 2)), list(range(101, 120, 2))]
    assert got[3] == {"": {200, 201}}
    assert late.count() == 0


def test_no_reads(spark):
    leaves, late = phasing.phased(spark.createDataFrame([], "g long, read long, seq string"), "g", "read", "seq", 3, 0.1)
    assert leaves.count() == late.count() == 0
