"""Reading order against a walk from the roots, for chains, stars, forests, and parents that aren't there."""

import random

import pytest

from ampliform.operators import tree

SCHEMA = "g long, name long, parent long, size long"


def walk(rows):
    kids, names = {}, {n for n, _, _ in rows}
    for n, p, s in rows:
        kids.setdefault(p if p in names else None, []).append((-s, n))
    out = {}

    def go(n, depth, bars, last):
        out[n] = (depth, len(out) + 1, "" if depth == 0 else bars + ("└─ " if last else "├─ "))
        below = sorted(kids.get(n, []))
        for i, (_, k) in enumerate(below):
            go(k, depth + 1, bars if depth == 0 else bars + ("   " if last else "│  "), i == len(below) - 1)

    for i, (_, r) in enumerate(sorted(kids.get(None, []))):
        go(r, 0, "", i == len(kids[None]) - 1)
    return out


def test_reading_order(spark):
    rng = random.Random(4)
    data, want = [], {}
    for g in range(6):
        n = (1, 2, 40, 30, 50, 12)[g]
        rows = []
        for i in range(n):
            parent = None if i == 0 else i - 1 if g == 2 else 0 if g == 3 else rng.randrange(i) if rng.random() < 0.9 else rng.choice((None, 999))
            rows.append((100 * g + i, parent if parent in (None, 999) else 100 * g + parent, rng.randrange(1, 6)))
        data += [(g, *r) for r in rows]
        want |= walk(rows)
    got = {r.name: (r.depth, r.place, r.lead) for r in tree.reading_order(spark.createDataFrame(data, SCHEMA), ["g"], "name", "parent", "size").collect()}
    assert got == want
    assert max(d for d, _, _ in want.values()) == 39


def test_circles(spark):
    with pytest.raises(ValueError, match="circle"):
        tree.paths(spark.createDataFrame([(1, 1, 2, 1), (1, 2, 1, 1)], SCHEMA), ["g"], "name", "parent", "size")
    assert tree.reading_order(spark.createDataFrame([], SCHEMA), ["g"], "name", "parent", "size").count() == 0


def test_trees_are_walked_whole(spark, monkeypatch):
    """Small trees take no rounds over paths, whose size grows with the square of a deep tree; larger ones still do, and both draw the same."""
    rng = random.Random(8)
    data = [(g, 1000 * g + i, None if i < 2 else 1000 * g + max(0, i - 1 - rng.randrange(3)), rng.randrange(1, 9)) for g, n in ((1, 400), (2, 30), (3, 600)) for i in range(n)]
    data.append((None, 5000, 1001, 1))
    want = {}
    for g in (1, 2, 3, None):
        want |= walk([r[1:] for r in data if r[0] == g])
    rows = spark.createDataFrame(data, SCHEMA)
    draw = lambda: {r.name: (r.depth, r.place, r.lead) for r in tree.reading_order(rows, ["g"], "name", "parent", "size").collect()}
    monkeypatch.setattr(tree, "BYTES", 5000)
    asked, paths = [], tree.paths
    monkeypatch.setattr(tree, "paths", lambda n, *a: (asked.append(n.select("g").distinct().count()), paths(n, *a))[1])
    assert draw() == want and not asked
    assert max(d for d, _, _ in want.values()) > 2 * tree.BLOCK
    monkeypatch.setattr(tree, "WHOLE", 500)
    assert draw() == want and asked == [1]


def test_circles_in_a_walk(spark):
    with pytest.raises(Exception, match="circle"):
        tree.reading_order(spark.createDataFrame([(1, 1, None, 1), (1, 2, 3, 1), (1, 3, 2, 1)], SCHEMA), ["g"], "name", "parent", "size").collect()
