"""Overlap of rows of different extent, counted observations and counted rows: the same results, with no cell or read exchanged for itself."""

import random

import pytest

from ampliform.operators import columns, fitting, runs
from ampliform.operators.tables import cut


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def extent(t):
    return len(t) - len(t.lstrip("-")), len(t.rstrip("-")) - 1


def plain(rows):
    """(overlap, prefix, suffix, snps) and (consensus, codes) of rows (text, weight)."""
    spans = [extent(t) for t, _ in rows]
    low, high = max(f for f, _ in spans), min(e for _, e in spans)
    full = [p for p in range(low, high + 1) if all(t[p] != "-" for t, _ in rows)]
    summary = (len(full), low - min(f for f, _ in spans), max(e for _, e in spans) - high, sum(len({t[p] for t, _ in rows}) > 1 for p in full))
    out, codes = "", 0
    for p in range(max(len(t) for t, _ in rows)):
        own = [(t[p].upper(), w) for (t, w), (f, e) in zip(rows, spans, strict=True) if f <= p <= e]
        mask = 0
        for b, _ in own:
            mask |= {"-": 0, "A": 1, "C": 2, "G": 4, "T": 8, "R": 5}.get(b, 15)
        bases, every = sum(w for b, w in own if b != "-"), sum(w for _, w in own)
        if mask and (not low <= p <= high or bases >= 0.5 * every and bases >= 3):
            out += "-ACMGRSVTWYHKDBN"[mask]
            codes += mask not in (1, 2, 4, 8)
    return summary, (out, codes) if out else None


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_overlap_of_whole_rows(spark, batch):
    rnd = random.Random(2)
    data = []
    for g in range(40):
        width = rnd.randrange(1, 30)
        for _ in range(rnd.choice((1, 2, 5, 14))):
            t = "".join(rnd.choice("AACCGTa-RN") for _ in range(width + (g % 7 == 0) * rnd.randrange(4)))
            cut_at = rnd.randrange(0, width)
            data.append((g, rnd.choice((t, t[:cut_at] + "-" * (len(t) - cut_at), "-" * cut_at + t[cut_at:])), rnd.randrange(1, 9)))
    want = {g: plain([(t, w) for h, t, w in data if h == g]) for g in range(40)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = cut(spark.createDataFrame(data, "g long, row string, w long"))
        s, c = columns.overlap_summary(df, "g", "row"), columns.overlap_consensus(df, "g", "row", "w")
        assert "Generate" not in plan(s) + plan(c)
        assert {r.g: (r.overlap, r.prefix, r.suffix, r.snps) for r in s.collect()} == {g: x for g, (x, _) in want.items()}
        assert {r.g: (r.consensus, r.snp_count) for r in c.collect()} == {g: y for g, (_, y) in want.items() if y}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_without_text(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "AC", 4), (3, "--", 2), (3, "AC", 2)], "g long, row string, w long")
    assert {tuple(r) for r in columns.overlap_summary(df, "g", "row").collect()} == {(1, 0, None, None, 0), (2, 0, 0, 2, 0), (3, 0, 2, 2, 0)}
    assert {tuple(r) for r in columns.overlap_consensus(df, "g", "row", "w").collect()} == {(2, "AC", 0), (3, "AC", 0)}


def test_observations_are_counted_once(spark):
    rnd = random.Random(4)
    data = [(g, 0, "A", 3, i, rnd.choice((3, 3, 3, 2, 4, 1, 6)), rnd.choice(("clean", "clean", "complex"))) for g in range(3) for i in range(50)]
    obs = cut(spark.createDataFrame(data, "g int, start int, run_base string, length long, read long, called long, status string"))
    few = runs.tally(obs, "g")
    assert few.count() <= 15
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rounded(runs.by_context(few)) == rounded(runs.by_context(obs))
    context = runs.by_context(obs)
    for f in (lambda o: fitting.outliers(o, context, "g", 100.0), lambda o: runs.bimodal(o, context, "g", 0.01, 0.1), lambda o: fitting.modes(o.where("status = 'clean'"), ["g", "start"], "called")):
        assert rounded(f(few)) == rounded(f(obs))
    d = [c - 3 for _, _, _, _, _, c, s in data if s == "clean"]
    mean = sum(d) / len(d)
    assert rounded(context)[0][-2:] == (round(3 + mean, 9), round((sum((x - mean) ** 2 for x in d) / len(d)) ** 0.5, 9))


def test_equal_rows_are_split_once(spark, monkeypatch):
    seen = []
    composition = columns.composition
    monkeypatch.setattr(columns, "composition", lambda rows, *more: (seen.append(rows.count()), composition(rows, *more))[1])
    data = [(1, i, "ACGT" if i % 2 else "ACTA") for i in range(40)] + [(1, 40, None)]
    out = columns.recursive_splits(spark.createDataFrame(data, "g long, read long, row string"), "g", "read", "row", 5, 0.1)
    assert {r.read: (r.path, r.deferred) for r in out.collect() if r.read < 40} == {i: ("2G" if i % 2 else "2T", False) for i in range(40)}
    assert out.count() == 41 and seen == [3, 2]
