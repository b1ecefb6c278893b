"""Reads settle as in a plain loop over rounds; discarded reads are taken or left as distances and votes say."""

import random

from ampliform.operators import reassignment

TURN = str.maketrans("ACGT", "CATG")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def settle(reads):
    """reads: {read: (cluster, text)} of one group and one length."""
    where, seen = {r: c for r, (c, _) in reads.items()}, []
    while where not in seen:
        seen.append(dict(where))
        cons = {}
        for c in sorted(set(where.values())):
            texts = [reads[r][1] for r in where if where[r] == c]
            cons[c] = "".join(max("ACGT", key=lambda b: (sum(t[i] == b for t in texts), -"ACGT".index(b))) for i in range(len(texts[0])))  # noqa: B023
        cols = [i for i in range(len(next(iter(cons.values())))) if len({x[i] for x in cons.values()}) > 1]
        if not cols:
            break
        for r, (_, t) in reads.items():
            best = min(cons, key=lambda c: (-sum(t[i] == cons[c][i] for i in cols), c != where[r], c))  # noqa: B023
            if best != seen[-1][r] and edits(t, cons[best]) <= edits(t, cons[seen[-1][r]]):
                where[r] = best
    return where


def test_reads_settle(spark):
    rng = random.Random(10)
    data, want = [], {}
    for g in range(5):
        base = "".join(rng.choice("AC") + rng.choice("GT") for _ in range(20))
        heads = []
        for _ in range((1, 2, 3, 4, 3)[g]):
            t = list(base)
            for i in rng.sample(range(40), 3):
                t[i] = t[i].translate(TURN)
            heads.append("".join(t))
        reads = {}
        for i in range(30):
            k = rng.randrange(len(heads))
            t = list(heads[k])
            for j in rng.sample(range(40), rng.randrange(0, 3)):
                t[j] = t[j].translate(TURN)
            reads[100 * g + i] = (k if rng.random() < 0.7 else rng.randrange(len(heads)), "".join(t))
        data += [(g, c, r, t) for r, (c, t) in reads.items()]
        want |= settle(reads)
    data += [(9, 1, 900, None), (9, 2, 901, ""), (9, 2, 902, "ACGT")]
    want |= {900: 1, 901: 2, 902: 2}
    got = {r.read: r.c for r in reassignment.reassigned(spark.createDataFrame(data, "g long, c long, read long, seq string"), "g", "c", "read", "seq").collect()}
    assert got == want
    assert any(got[r] != c for _, c, r, _ in data)
    none = spark.createDataFrame([], "g long, c long, read long, seq string")
    assert reassignment.reassigned(none, "g", "c", "read", "seq").count() == 0


def test_discards(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("AC") + rng.choice("GT") for _ in range(n // 2))
    turned = lambda t, *at: "".join(x.translate(TURN) if i in at else x for i, x in enumerate(t))
    a, b = text(80), text(80)
    cons = [(1, 1, 1, a), (1, 1, 2, turned(a, 10, 40)), (1, 1, 3, turned(a, 11)), (1, 2, 4, b), (2, 1, 5, b), (1, 3, 6, None)]
    reads = {100: (1, a), 101: (1, turned(a, 10, 40, 60)), 102: (1, turned(a, 11, 50, 70)), 103: (1, turned(b, 3, 9)), 104: (1, text(80)), 105: (1, None), 106: (2, a), 107: (2, b[:-2]), 108: (1, turned(a, 10, 40)[:30] + turned(a, 10, 40)[31:]), 109: (3, a), 110: (1, turned(a, *range(0, 24, 2)))}
    df = spark.createDataFrame([(s, r, t) for r, (s, t) in reads.items()], "s long, read long, seq string")
    got = {r.read: (r.g, r.c) for r in reassignment.recovered(df, spark.createDataFrame(cons, "s long, g long, c long, consensus string"), "s", "g", "c", "read", "seq", 0.9).collect()}
    assert got == {100: (1, 1), 101: (1, 2), 102: (1, 3), 103: (2, 4), 107: (1, 5), 108: (1, 2)}
    near = {r.read: (r.c, round(r.distance, 9)) for r in reassignment.nearest_consensus(df, spark.createDataFrame(cons, "s long, g long, c long, text string"), "s", "read", "c", 0.9).collect()}
    want = {}
    for r, (s, t) in reads.items():
        each = [(round(edits(t, x) / max(len(t), len(x)), 9), c) for k, _, c, x in cons if k == s and x and t]
        if each and min(each)[0] <= 0.1:
            want[r] = min(each)[::-1]
    assert near == want


