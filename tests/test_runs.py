"""Runs of gapped rows, told from each row alone, against plain loops; alignments within a band against whole matrices."""

import itertools
import random

from ampliform.operators import alignments, columns, frames, pairwise


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_of_rows_exchange_nothing(spark):
    rng = random.Random(5)
    rows = ["", "-", "A", "--AA-A--", "AA--CC", "A---C", "aaa-", *("".join(rng.choice("AAC-") for _ in range(30)) for _ in range(40))]
    r = spark.createDataFrame(list(enumerate(rows)), "id long, row string")
    every, shown = columns.run_columns(r, "id", "row", 2), columns.run_columns(r, "id", "row", 2, shown=4)
    anchors = columns.anchors_of_rows(r, "id", "row", 30, 2)
    assert "Exchange" not in plan(every) + plan(anchors)
    assert {tuple(x) for x in shown.collect()} == {tuple(x) for x in every.where("base = '-' or run_length >= 4").collect()}
    want = columns.run_anchors(every, "id", 30, 2).select(anchors.columns)
    assert {tuple(x) for x in anchors.collect()} == {tuple(x) for x in want.collect()}
    got = {(x.id, x.pos): x.asDict() for x in every.collect()}
    assert set(got) == {(i, k) for i, t in enumerate(rows) for k in range(len(t))}
    for i, t in enumerate(rows):
        t, solid = t.upper(), [k for k, c in enumerate(t) if c != "-"]
        runs = [[k for _, k in g] for _, g in itertools.groupby(((t[k], k) for k in solid), key=lambda x: x[0])]
        for k, c in enumerate(t):
            own = next((x for x in reversed(runs) if x[0] <= k), None)
            x = got[i, k]
            assert (x["base"], x["place"]) == (c, solid.index(k) if c != "-" else None)
            assert (x["run_base"], x["run_start"], x["run_stop"], x["run_length"]) == ((t[own[0]], own[0], own[-1], len(own)) if own else (None, None, None, 0))
            tag = lambda x: t[x[0]] if x and len(x) >= 2 else None
            after = next((x for x in runs if x[-1] > k), None)
            if c != "-" or own and k < own[-1]:
                assert x["context"] == tag(own)
            elif tag(own) and tag(after):
                assert x["context"] == (tag(own) if t[k + 1] == "-" else None)
            else:
                assert x["context"] == (tag(own) or tag(after))


def test_band(monkeypatch):
    """Pairs near each other never take a whole matrix, and come out as they do from one."""
    rng = random.Random(7)
    pairs = []
    for _ in range(300):
        a = [rng.choice("ACGT") for _ in range(rng.choice([0, 1, 20, 96]))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(["A", "C", "G", "T", "", "AC"])
        pairs.append(("".join(a), "".join(b)))
    a, b = map(list, zip(*pairs, strict=True))
    want = [x for s in pairwise._batches(a, b) for x in pairwise._align(a[s], b[s])]
    assert list(pairwise.align([*a, "ACGT" * 30], [*b, "TTT"])) == [*want, *pairwise._align(["ACGT" * 30], ["TTT"])]
    monkeypatch.setattr(pairwise, "_align", None)
    assert list(pairwise.align(a, b)) == want
    for p, q in [*want, ("AA--AAAAAAC-", "AAAAA--AACCG"), ("A-", "-C"), ("--AA", "CAA-")]:
        assert pairwise.compared(p, q) == (sum(x != y for x, y in zip(p, q, strict=True)), *pairwise.events(p, q), pairwise.tags(p, q), pairwise.run_free_distance(p, q)[0])


def test_errors_of_reads_and_copies(spark):
    """Only columns that differ become rows; a row that counts several times is as good as so many."""
    rng = random.Random(9)
    rows = [(i % 2, i, "".join(rng.choice("ACGTN-a") for _ in range(rng.choice([0, 7, 12])))) for i in range(30)]
    cons = [(g, k, rng.choice("ACGT-")) for g in range(2) for k in range(12) if k != 3]
    r, c = spark.createDataFrame(rows, "g int, id long, row string"), spark.createDataFrame(cons, "g int, pos int, base string")
    got = columns.read_errors(r, c, "g", "id", "row")
    assert "posexplode" not in plan(got)
    top, plain = {(g, k): b for g, k, b in cons}, lambda x: x if x in "ACGT" else "-"
    want = {(g, i, k, "ins" if top[g, k] == "-" else "del" if plain(x) == "-" else "sub", plain(x)) for g, i, t in rows for k, x in enumerate(t.upper()) if top.get((g, k), plain(x)) != plain(x)}
    assert {tuple(x) for x in got.collect()} == want
    few = r.selectExpr("g", "row", "id % 3 + 1 as n")
    each = few.selectExpr("g", "row", "explode(sequence(1, n)) as i")
    assert {tuple(x) for x in alignments.composition(few, "g", "n", "row", "n").collect()} == {tuple(x) for x in alignments.composition(each, "g", "i", "row").collect()}


def test_equal_reads_are_scored_once(spark):
    """Reads meet what is known of their sequence; no alignment or score stands above the join to them."""
    reads = spark.createDataFrame([(1, i, s) for i, s in enumerate(["ACGTACGTAC"] * 5 + ["acgtacgac", None])] + [(None, 99, "ACGT")], "g int, id long, seq string")
    found = frames.class_rows(reads, "g", "seq")
    got = {x.id: x.row_aln for x in frames.of_reads(reads, found, "g", "id", "seq").collect()}
    assert got == {x.id: x.row_aln for x in frames.common_columns(reads, "g", "id", "seq").collect()}
    assert sorted(got) == list(range(7)) and {got[i] for i in range(5)} == {"ACGTACGTAC"}
    assert {x.copies for x in found.where("g = 1").collect()} == {5, 1}
