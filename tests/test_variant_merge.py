"""Variants merge as one batch after another would, in plain Python; prefix, suffix and whole meet; events and limits."""

import itertools
import random

import numpy as np
import pytest

from ampliform.operators import curation
from ampliform.operators.variant_merge import Limits, align_few, best_subset, differences, merge_variants

CODE = {"A": 1, "C": 2, "M": 3, "G": 4, "R": 5, "S": 6, "V": 7, "T": 8, "W": 9, "Y": 10, "H": 11, "K": 12, "D": 13, "B": 14, "N": 15}
LETTER = {m: c for c, m in CODE.items()}
SCHEMA = "g long, name long, seq string, size long, ric long, primers array<string>"


def plain(rows, positions, batch):
    """rows: (name, seq, size) of one length. (members, seq, size) of what is left."""
    left, out = sorted(rows, key=lambda r: (-r[2], r[0])), []
    while left:
        some = left[:batch]
        order = [c for r in range(len(some), 0, -1) for c in itertools.combinations(range(len(some)), r)]
        for c in sorted(order, key=lambda c: -sum(some[i][2] for i in c)):
            cols = [{some[i][1][k] for i in c} for k in range(len(some[0][1]))]
            if sum(len(x) > 1 for x in cols) <= positions:
                text = "".join(next(iter(x)) if len(x) == 1 else LETTER[sum(CODE[b] for b in x)] for x in cols)
                out.append((tuple(some[i][0] for i in c), text, sum(some[i][2] for i in c)))
                left = [r for k, r in enumerate(left) if k not in c]
                break
    return sorted(out)


def test_set_packing(spark):
    rng = random.Random(1)
    data, want = [], {}
    for g in range(6):
        base = "".join(rng.choice("AC") + rng.choice("GT") for _ in range(12))
        rows = []
        for i in range((1, 4, 9, 13, 6, 5)[g]):
            t = list(base)
            for k in rng.sample(range(24), rng.randrange(0, 4)):
                t[k] = {"A": "C", "C": "A", "G": "T", "T": "G"}[t[k]]
            rows.append((100 * g + i, "".join(t), rng.randrange(1, 30)))
        data += [(g, *r, 1, None) for r in rows]
        want[g] = plain(rows, 2, 4)
    df = spark.createDataFrame(data, SCHEMA)
    got = {}
    for r in merge_variants(df, ["g"], "name", "seq", "size", "ric", "primers", Limits(positions=2, floor=0, fraction=0), 4).collect():
        got.setdefault(r.g, []).append((tuple(r.members), r.seq, r["size"]))
        assert r.ric == len(r.members)
        assert r.name == r.members[0]
    assert {g: sorted(x) for g, x in got.items()} == want


def test_prefix_suffix_and_whole(spark):
    """Prefix and suffix overlap too little to meet, but both merge with the whole; then what is merged merges on."""
    rng = random.Random(7)
    whole = "".join(rng.choice("ACGT") for _ in range(300))
    rows = [(1, 1, whole, 50, 5, ["a", "d"]), (1, 2, whole[:170], 30, 5, ["a", "b"]), (1, 3, whole[150:], 20, 5, ["c", "d"])]
    rows += [(2, 4, whole[:170], 30, 5, ["a", "b"]), (2, 5, whole[60:260], 20, 5, ["c", "d"]), (2, 6, whole[150:], 10, 5, ["e", "f"])]
    rows += [(3, 7, whole, 50, 5, ["a", "d"]), (3, 8, whole[:170], 30, 5, ["a", "d"]), (4, 9, None, 5, 1, None)]
    got = {}
    for r in merge_variants(spark.createDataFrame(rows, SCHEMA), ["g"], "name", "seq", "size", "ric", "primers", Limits(overlap=80), 2).collect():
        got.setdefault(r.g, []).append((sorted(r.members), r.seq, r["size"]))
    assert got[1] == [([1, 2, 3], whole, 100)]
    assert got[2] == [([4, 5, 6], whole, 60)]  # the first two join, and only what they give reaches the third
    assert sorted(got[3]) == [([7], whole, 50), ([8], whole[:170], 30)]  # same primers: extents must not differ
    assert got[4] == [([9], "", 5)]


def _batch(*seqs, **more):
    return [{"name": i, "seq": s, "size": 100 - i, "ric": 1, "primers": [], "snps": 0, "indels": 0, "members": [i]} | more for i, s in enumerate(seqs)]


def test_limits():
    core = "ACGTTGCAGGCTAACGATCCATGACTTAGC"
    snp, indel, long, run = core[:9] + "C" + core[10:], core[:4] + core[5:], core[:10] + core[14:], core.replace("TTAGC", "TTTAGC")
    take = lambda *s, **k: len(best_subset(_batch(*s), Limits(**k))[0])
    assert take(core, snp) == 2
    assert take(core, snp, snps=False) == 1
    assert take(core, snp, positions=0) == 1
    assert take(core, run) == 2
    assert take(core, run, strict=True) == 1
    assert take(core, run, strict=True, indel=1) == 2
    assert take(core, run, run=4) == 1
    assert take(core, long, indel=3) == 1
    assert take(core, long, indel=4) == 2
    assert take(core, snp, ratio=0.6) == 1
    assert len(best_subset(_batch(core, snp, snps=1, indels=1), Limits(positions=4))[0]) == 1
    assert len(best_subset(_batch(core, snp, snps=1, indels=1), Limits(positions=5))[0]) == 2
    assert take(core, indel, indel=1, run=9) == 2


def test_events():
    rows = lambda *t: np.stack([np.frombuffer(x.encode(), np.uint8) for x in t])
    d = lambda *t, **k: differences(rows(*t), Limits(**k), False)
    assert d("ACGT", "ACGT") == {"snps": 0, "indels": 0, "longest": 0, "overlap": 4}
    assert d("ACGTAC", "AC--AC")["longest"] == 2
    assert d("ACGTAC", "A-GT-C")["indels"] == 2
    assert d("AAAC", "A--C")["indels"] == 0
    assert d("AAAC", "A--C", run=2)["indels"] == 1
    assert d("ACGT", "AGGT")["snps"] == 1
    few = align_few(["ACGTTGCA", "ACGTGCA", "ACGTTTGCA"])
    assert sorted(bytes(r).decode().replace("-", "") for r in few) == ["ACGTGCA", "ACGTTGCA", "ACGTTTGCA"]


@pytest.mark.parametrize(("snps", "indels", "size", "ok"), [(2, 1, 3, True), (3, 1, 3, False), (2, 2, 3, False), (2, 1, 4, False)])
def test_within_limits(spark, snps, indels, size, ok):
    df = spark.createDataFrame([(snps, 1, indels, 0, size)], "snps int, prior_snps int, indels int, prior_indels int, indel_length int")
    assert df.select(curation.within_limits(df, 3, 1, 3).alias("ok")).first().ok is ok
