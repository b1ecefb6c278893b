"""What grows with the input stays off the driver, and rows of small groups are exchanged whole."""

import pandas as pd
import pytest

from ampliform.operators import alignments, runs, significance, tree
from ampliform.operators.tables import cut
from ampliform.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tails_all_at_a_time(monkeypatch):
    m, n, q = [1, 3, 50, 900, 60_000, 0, 7], [10, 9, 10_000, 200_000, 180_000, 5, 9], [0.0039] * 5 + [0.5, 1.0]
    want = [significance.log_tail(a, b, significance.math.log(c)) for a, b, c in zip(m, n, q, strict=True)]
    monkeypatch.setattr(significance, "log_tail", None)  # sums n - m terms
    got = significance.log_tail_of.func(pd.Series(m), pd.Series(n), pd.Series(q))
    assert got.tolist() == [pytest.approx(w, rel=1e-7, abs=1e-7) for w in want]
    none = significance.log_tail_of.func(pd.Series([1, 1]), pd.Series([2, 2]), pd.Series([0.0, None]))
    assert none.isna().all()


def test_other_errors_stay_off_the_driver(spark):
    rows = cut(spark.createDataFrame([(1, 1, "ACGT-"), (1, 2, "ACGTA"), (1, 3, "ACCT-"), (2, 4, "GA")], "donor int, read_id long, row_aln string"))
    e = runs.other_errors(rows, "donor", "read_id", "row_aln")
    assert "BroadcastHashJoin" not in plan(e)
    assert {tuple(r) for r in e.collect()} == {(1, 11, 1, 0, 1, 3), (2, 2, 0, 0, 0, 1)}


def test_paths_stay_off_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(tree, "cut", lambda df: (plans.append(plan(df)), cut(df))[1])
    nodes = cut(spark.createDataFrame([(1, 1, None, 5), (1, 2, 1, 4), (1, 3, 2, 3), (1, 4, 1, 2)], "g int, name long, parent long, size long"))
    p = tree.paths(nodes, ["g"], "name", "parent", "size")
    assert {r.name: r.path for r in p.collect()} == {1: [3], 2: [3, 2], 3: [3, 2, 3], 4: [3, 5]}
    assert len(plans) == 3 and not any("BroadcastHashJoin" in x for x in plans)


@pytest.mark.parametrize("name", ["columns_without_majority"])
def test_rows_of_small_groups_are_exchanged_whole(spark, name):
    assert plan(QUERIES[name](spark, "/root/testdata/sf0.001")).count("Exchange") == 1


def test_cells_at_positions(spark):
    rows = cut(spark.createDataFrame([(1, 1, "ACgT-"), (1, 2, "NCG"), (2, 3, "TTTT"), (3, 4, "A")], "g int, id long, row string"))
    pos = spark.createDataFrame([(1, 0), (1, 4), (2, 2)], "g int, pos int")
    want = alignments.cells(rows, "g", "id", "row").join(pos, ["g", "pos"]).select("g", "id", "pos", "base")
    c = alignments.cells_at(rows, pos, "g", "id", "row")
    assert sorted(map(tuple, c.collect())) == sorted(map(tuple, want.collect()))
    assert "posexplode" not in plan(c)
