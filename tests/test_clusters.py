"""Clusterings as rounds of joins against doing one step after another."""

import itertools
import random

import numpy as np
import pytest

from ampliform.operators import graph
from ampliform.operators.tables import cut


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    nodes, edges = [], []
    for g in range(3):
        names = list(range(g * 100, g * 100 + 14 + 5 * g))
        nodes += [(g, n) for n in names]
        place = {n: rng.randrange(4) * 10 + rng.random() * 3 for n in names}
        for a, b in itertools.combinations(names, 2):
            d = round(abs(place[a] - place[b]), 1) / 100
            if d < 0.025:
                edges.append((g, a, b, d))
    return nodes, edges, spark.createDataFrame(nodes, "g int, id long"), spark.createDataFrame(edges, "g int, src long, dst long, distance double")


def greedy(names, edges):
    around = {n: set() for n in names}
    for a, b in edges:
        around[a].add(b)
        around[b].add(a)
    out = set()
    while around:
        centre = min(around, key=lambda n: (-len(around[n]), n))
        members = around[centre] | {centre}
        out |= {(centre, m) for m in members}
        for m in members:
            for n in around.pop(m):
                if n not in members:
                    around[n].discard(m)
    return out


def test_greedy(case):
    nodes, edges, n, e = case
    got = {(r.g, r.cluster, r.id) for r in graph.greedy_clusters(n, e, "g", "id").collect()}
    want = {(g, c, m) for g in range(3) for c, m in greedy([i for h, i in nodes if h == g], [(a, b) for h, a, b, _ in edges if h == g])}
    assert got == want


def linkage(names, distances, most):
    parts = {n: [n] for n in names}
    d = {tuple(sorted((a, b))): x for a, b, x in distances}
    far = lambda p, q: max(d.get(tuple(sorted((a, b))), 1) for a in p for b in q)
    while True:
        best = min(((far(parts[a], parts[b]), a, b) for a, b in itertools.combinations(sorted(parts), 2)), default=None)
        if best is None or best[0] > most:
            return {(n, m) for n, p in parts.items() for m in p}
        parts[best[1]] += parts.pop(best[2])


def test_linkage(case):
    nodes, edges, n, e = case
    got = {(r.g, r.cluster, r.id) for r in graph.linkage_groups(n, e, "g", "id", 0.02).collect()}
    want = {(g, c, m) for g in range(3) for c, m in linkage([i for h, i in nodes if h == g], [(a, b, x) for h, a, b, x in edges if h == g], 0.02)}
    assert got == want


def flow(names, edges, inflation=4.0):
    at = {n: i for i, n in enumerate(names)}
    m = np.eye(len(names))
    for a, b, w in edges:
        m[at[a], at[b]] = m[at[b], at[a]] = w
    m /= m.sum(axis=0)
    for _ in range(100):
        new = m @ m
        new = np.power(new / new.max(axis=0), inflation)
        new[new < 1e-6] = 0
        new /= new.sum(axis=0)
        if np.abs(new - m).max() < 1e-8:
            break
        m = new
    label = list(range(len(names)))
    for _ in names:
        for i, j in zip(*np.nonzero(m > 1e-5), strict=True):
            label[i] = label[j] = min(label[i], label[j])
    return {(names[label[i]], n) for i, n in enumerate(names)}


def test_flow(case):
    nodes, edges, n, e = case
    e = e.selectExpr("g", "src", "dst", "round(pow(1 - distance, 2), 6) as weight")
    got = {(r.g, r.cluster, r.id) for r in graph.flow_clusters(n, e, "g", "id").collect()}
    want = {(g, c, m) for g in range(3) for c, m in flow([i for h, i in nodes if h == g], [(a, b, round((1 - x) ** 2, 6)) for h, a, b, x in edges if h == g])}
    assert got == want


def test_flow_of_many_neighbours(spark):
    """A clique of 70 and one of 40, tied by one edge; a flow that swings is told."""
    one, two = list(range(70)), list(range(100, 140))
    edges = [(1, a, b, 1.0) for part in (one, two) for a, b in itertools.combinations(part, 2)] + [(1, 0, 100, 0.1)]
    n = spark.createDataFrame([(1, i) for i in one + two], "g long, id long")
    e = spark.createDataFrame(edges, "g long, src long, dst long, weight double")
    assert {(r.cluster, r.id) for r in graph.flow_clusters(n, e, "g", "id").collect()} == flow(one + two, [x[1:] for x in edges])
    with pytest.raises(RuntimeError, match="settle"):
        graph.flow_clusters(n, e, "g", "id", rounds=1)


def test_flow_of_small_groups(spark, case, monkeypatch):
    """Small groups take no rounds of joins and give what the rounds give; reads without edges stand alone."""
    _, _, n, e = case
    e = e.selectExpr("g", "src", "dst", "round(pow(1 - distance, 2), 6) as weight")
    n = n.union(spark.createDataFrame([(9, 900), (9, 901), (None, 5)], n.schema))
    rounds = graph._flow_rounds
    monkeypatch.setattr(graph, "_flow_rounds", lambda *a: pytest.fail("rounds for small groups"))
    whole = {tuple(r) for r in graph.flow_clusters(n, e, "g", "id").collect()}
    monkeypatch.setattr(graph, "_flow_rounds", rounds)
    monkeypatch.setattr(graph, "PAIRED", 0)
    assert {tuple(r) for r in graph.flow_clusters(n, e, "g", "id").collect()} == whole
    assert {(9, 900, 900), (9, 901, 901), (None, 5, 5)} <= whole


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [20, 90])
def test_edges(spark, size):
    """Groups below and above the size up to which all pairs are tried; windows are never broadcast, edges not computed twice."""
    rng = random.Random(size)
    base = "".join(rng.choice("ACGT") for _ in range(96))
    reads = []
    for i in range(size):
        s = list(base)
        for _ in range(rng.randrange(4)):
            s[rng.randrange(len(s))] = rng.choice(["A", "C", "G", "T", "", "AC"])
        reads.append((1, i, "".join(s)))
    r = cut(spark.createDataFrame([*reads, (2, 1000, ""), (2, 1001, "")], "g int, id long, seq string"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for (_, i, a), (_, j, b) in itertools.combinations(reads, 2):
        longer, d = max(len(a), len(b)), distance(a, b)
        if d <= int((1 - 0.97) * longer):
            want[i, j] = pytest.approx(1 - d / longer)
    e = lambda: graph.edges(r, "g", "id", "seq", 0.97, k=24)
    assert {(x.src, x.dst): x.sim for x in e().collect()} == want
    assert "BroadcastHashJoin" not in plan(graph.candidate_pairs(r, "g", "id", "seq", 24))
    assert plan(graph.star_centres(e(), "g")).count("levenshtein") == plan(e()).count("levenshtein")


def test_connected_counts_many_edges(spark, monkeypatch):
    """The marks of a round's edges are added up; those of a few hundred thousand passed 2^63. Here the largest mark stands for many."""
    monkeypatch.setattr(graph.F, "xxhash64", lambda *c: graph.F.lit((1 << 63) - 1))
    e = spark.range(300).selectExpr("2 * id + 1 as src", "2 * id as dst")
    found = {r.node: r.component for r in graph.connected(e).collect()}
    assert found == {n: n - n % 2 for n in range(600)}
