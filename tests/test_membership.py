"""The later phases: no read is lost or doubled, noise goes, what belongs elsewhere comes there, and changed clusters split."""

import random

from ampliform.operators import membership

TURN = str.maketrans("ACGT", "CATG")


def test_later_phases(spark):
    rng = random.Random(6)
    text = lambda: "".join(rng.choice("AC") + rng.choice("GT") for _ in range(40))
    turned = lambda t, *at: "".join(x.translate(TURN) if i in at else x for i, x in enumerate(t))
    a, far = text(), text()
    b = turned(a, 20, 50)
    third = turned(a, 7, 33)
    rows = [(1, 1, "a", i, a) for i in range(12)] + [(1, 1, "b", 20 + i, b) for i in range(8)] + [(1, 1, "a", 40, b)]  # one read of b stands in a
    rows += [(1, 1, "noise", 50, turned(a, 3)), (1, 1, "noise", 51, turned(a, 11))]  # two that agree nowhere they differ: they go back to a
    rows += [(1, None, None, 60 + i, third) for i in range(6)]  # a haplotype that was discarded whole comes back, and splits off
    rows += [(1, None, None, 70, far), (1, None, None, 71, None), (2, 1, "c", 100, far), (2, 1, "c", 101, far), (2, 1, "c", 102, None)]
    df = spark.createDataFrame(rows, "s long, g long, c string, read long, seq string")
    got = membership.later_phases(df, "s", "g", "c", "read", "seq", 4, 0.1, 0.9).collect()
    assert sorted(r.read for r in got) == sorted(r[3] for r in rows)
    where = {}
    for r in got:
        where.setdefault((r.s, r.g, r.c), set()).add(r.read)
    assert where.pop((1, None, None)) == {70, 71}
    assert where.pop((2, 1, "c")) == {100, 101, 102}
    assert sorted(map(sorted, where.values())) == [sorted([*range(12), 50, 51]), sorted([*range(20, 28), 40]), list(range(60, 66))]
    noisy = membership.noisy_clusters(df.where("c is not null and seq is not null"), "c", "read", "seq", 4)
    assert [r.c for r in noisy.collect()] == ["noise"]
