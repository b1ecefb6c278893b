"""Common columns: the alignment to a profile against a plain one, planted insertions, odd reads, scores against a loop."""

import random

import numpy as np

from ampliform.operators import frames


def plain_cost(profile, text):
    n, m = len(profile) // 5, len(text)
    cost = np.frombuffer(profile, np.uint8).reshape(-1, 5).astype(int)
    d = np.zeros((n + 1, m + 1), int)
    d[0] = np.arange(m + 1) * frames.FULL
    for i in range(1, n + 1):
        for j in range(m + 1):
            best = d[i - 1, j] + cost[i - 1, 4]
            if j:
                k = "ACGT".find(text[j - 1])
                best = min(best, d[i - 1, j - 1] + (cost[i - 1, k] if k >= 0 else frames.FULL), d[i, j - 1] + frames.FULL)
            d[i, j] = best
    return d[n, m]


def cost_of(profile, row, more):
    cost = np.frombuffer(profile, np.uint8).reshape(-1, 5).astype(int)
    total = sum(frames.FULL * len(t) for t in more.values())
    for i, c in enumerate(row):
        k = "ACGT-".find(c)
        total += cost[i, k] if k >= 0 else frames.FULL
    return total


def test_place():
    rng = random.Random(4)
    cases = [(b"", ""), (b"", "ACG"), (bytes([0, 200, 200, 200, 200]), ""), (bytes([0, 200, 200, 200, 200]), "NNA")]
    for _ in range(80):
        n = rng.randrange(0, 14)
        cases.append((bytes(rng.choice((0, 10, 60, 120, 200)) for _ in range(5 * n)), "".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 16)))))
    for (p, t), (row, more) in zip(cases, frames.place([c[0] for c in cases], [c[1] for c in cases]), strict=True):
        assert len(row) == len(p) // 5
        back = more.get(-1, "") + "".join(c.replace("-", "") + more.get(i, "") for i, c in enumerate(row))
        assert back == t
        assert cost_of(p, row, more) == plain_cost(p, t)


def test_common_columns(spark):
    """Long insertions of several reads share columns; rows spell their reads and are of one length."""
    core = "ACGTTGCAAGCTTACGGATCCATGAC"
    reads = [("a", i, core) for i in range(6)]
    reads += [("a", 10 + i, core[:10] + "TATA" + core[10:]) for i in range(3)] + [("a", 20, core[:10] + "TTA" + core[10:]), ("a", 21, "GG" + core), ("a", 22, core + "TTT"), ("a", 23, core[3:-3]), ("a", 24, None), ("a", 25, core.lower())]
    reads += [("b", 30, ""), ("b", 31, None), ("c", 32, "NNACGTN"), ("c", 33, "ACGT"), (None, 34, core)]
    df = spark.createDataFrame(reads, "g string, read long, seq string")
    got = {r.read: r.row_aln for r in frames.common_columns(df, "g", "read", "seq").collect()}
    for g, i, seq in reads:
        if g:
            assert got[i].replace("-", "") == (seq or "").upper()
    assert len({len(got[i]) for g, i, _ in reads if g == "a"}) == 1
    cut = [got[i] for i in (10, 11, 12, 20)]
    at = cut[0].index("TATA", 8)
    assert {c[at : at + 4] for c in cut[:3]} == {"TATA"}
    assert sorted(cut[3][at : at + 4].replace("-", "")) == sorted("TTA")
    assert got[0][at : at + 4] == "----"
    assert got[30] == got[31] == ""
    assert frames.common_columns(df.where("false"), "g", "read", "seq").count() == 0


def loop(row, consensus, context):
    score, normal, ins, dels, subs = "", "", 0, 0, 0
    for r, c, h in zip(row, consensus, context, strict=True):
        same, run = r == c, (r == "-" and c == h) or (c == "-" and r == h)
        score += "|" if same else "=" if run else " "
        normal += c if run and not same else r
        if not same:
            ins, dels, subs = ins + (c == "-"), dels + (r == "-"), subs + ("-" not in (r, c))
    bases = len(consensus.replace("-", ""))
    return score, normal, ins, dels, subs, 1 - score.count(" ") / bases


def test_scores(spark):
    rng = random.Random(9)
    rows, base = [], {}
    for g in range(4):
        base[g] = "".join(rng.choice("AACCCGT-") for _ in range(40))
        rows += [(g, 100 * g + i, "".join(c if rng.random() < 0.8 else rng.choice("ACGT-") for c in base[g])) for i in range(9)]
    df = spark.createDataFrame(rows, "g long, read long, row_aln string")
    for least in (1, 2, 3):
        cons = frames.run_context(frames.consensus_rows(df, "g"), "g", least)
        text = {r.g: (r.consensus, r.context) for r in cons.collect()}
        got = {r.read: (r.score, r.normal, r.insertions, r.deletions, r.substitutions, r.rid) for r in frames.scored(df, cons, "g").collect()}
        assert got == {i: loop(row, *text[g]) for g, i, row in rows}
    for g, (consensus, context) in text.items():
        bare = [c for c in consensus if c != "-"]
        for i, c in enumerate(consensus):
            if c != "-" and context[i] != ".":
                k = len(consensus[: i + 1].replace("-", "")) - 1
                low = high = k
                while low and bare[low - 1] == c:
                    low -= 1
                while high + 1 < len(bare) and bare[high + 1] == c:
                    high += 1
                assert context[i] == c
                assert high - low + 1 >= 3
