"""Pairwise alignment in Arrow batches: many pairs at a time, one numpy row of all their matrices per step.

Global alignment costs one for a substitution, an insertion and a deletion. Of equal ways the traceback, from the end,
takes a match or substitution first, then a gap in the second sequence, then one in the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Matrix cells of a batch.
CELLS = 4_000_000
#: Edits up to which a pair is aligned within so many columns of the diagonal.
BAND = 8


def _matrix(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts])
    out = np.full((len(texts), max(1, size.max(initial=1))), fill, np.uint8)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("ascii", "replace"), np.uint8)
    return out, size


def _batches(a: list[str], b: list[str]) -> Iterator[slice]:
    start, most = 0, 0
    for i in range(len(a) + 1):
        cells = max(most, (len(a[i]) + 1) * (len(b[i]) + 1)) if i < len(a) else 0
        if i == len(a) or cells * (i - start + 1) > CELLS and i > start:
            if i > start:
                yield slice(start, i)
            start, most = i, 0
            cells = (len(a[i]) + 1) * (len(b[i]) + 1) if i < len(a) else 0
        most = max(most, cells)


def align(a: list[str], b: list[str]) -> Iterator[tuple[str, str]]:
    """The aligned texts of each pair. All best ways of pairs of at most ``BAND`` edits lie within ``BAND`` columns of the diagonal, so what
    is beyond is computed for the other pairs alone."""
    for k in range(0, len(a), 2048):
        some, others = a[k : k + 2048], b[k : k + 2048]
        out = dict(enumerate(_banded(some, others)))
        far = [i for i, x in out.items() if x is None]
        one, two = [some[i] for i in far], [others[i] for i in far]
        for s in _batches(one, two):
            for i, x in zip(far[s], _align(one[s], two[s]), strict=True):
                out[i] = x
        yield from out.values()


def _banded(a: list[str], b: list[str]) -> Iterator[tuple[str, str] | None]:
    """The same within the band, column k of a row being place i + k - BAND of the second text; None for pairs of more edits, and for
    texts that are too long for the matrix."""
    fit = [i for i in range(len(a)) if len(a[i]) <= 512 and len(b[i]) <= 512 and abs(len(a[i]) - len(b[i])) <= BAND]
    if not fit:
        yield from [None] * len(a)
        return
    x, n = _matrix([a[i] for i in fit], 1)
    text, m = _matrix([b[i] for i in fit], 2)
    wide, rows = 2 * BAND + 1, np.arange(len(fit))
    y = np.full((len(fit), BAND + max(text.shape[1], x.shape[1] + BAND + 1)), 2, np.uint8)
    y[:, BAND : BAND + text.shape[1]] = text
    step = np.arange(wide, dtype=np.int16)
    d = np.full((x.shape[1] + 1, len(fit), wide + 1), 8192, np.int16)  # the last column is out of reach
    d[0, :, BAND:wide] = step[: wide - BAND]
    for i in range(1, len(d)):
        t = np.minimum(d[i - 1, :, 1:] + 1, d[i - 1, :, :wide] + (x[:, i - 1, None] != y[:, i - 1 : i - 1 + wide]))
        if i < BAND:
            t[:, : BAND - i] = 8192
        d[i, :, :wide] = np.minimum.accumulate(t - step, axis=1) + step
    near = d[n, rows, m - n + BAND] <= BAND
    i, j = np.where(near, n, 0), np.where(near, m, 0)
    ops = np.zeros((int((n + m).max(initial=0)), len(fit)), np.uint8)
    for s in range(len(ops)):
        live = (i > 0) | (j > 0)
        if not live.any():
            break
        k = np.clip(j - i + BAND, 0, wide - 1)
        here, up, left = d[i, rows, k], np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        both = (i > 0) & (j > 0) & (here == d[up, rows, k] + (x[rows, up] != text[rows, left]))
        one = ~both & (i > 0) & (here == d[up, rows, k + 1] + 1)
        two = live & ~both & ~one
        ops[s] = both + 2 * one + 3 * two
        i, j = i - (both | one), j - (both | two)
    at = dict(zip(fit, range(len(fit)), strict=True))
    for i in range(len(a)):
        yield _walked(ops[:, r], x[r, : n[r]], text[r, : m[r]]) if (r := at.get(i)) is not None and near[r] else None


def _walked(ops: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[str, str]:
    """The aligned texts by the steps back from their ends."""
    o = ops[ops > 0][::-1]
    p, q = np.full(len(o), 45, np.uint8), np.full(len(o), 45, np.uint8)
    p[o != 3], q[o != 2] = x, y
    return p.tobytes().decode("ascii", "replace"), q.tobytes().decode("ascii", "replace")


def _align(a: list[str], b: list[str]) -> Iterator[tuple[str, str]]:
    x, n = _matrix(a, 1)
    y, m = _matrix(b, 2)
    step = np.arange(y.shape[1] + 1, dtype=np.int32)
    d = np.empty((x.shape[1] + 1, len(a), y.shape[1] + 1), np.int32)
    d[0] = step
    for i in range(1, x.shape[1] + 1):
        t = d[i - 1] + 1
        t[:, 1:] = np.minimum(t[:, 1:], d[i - 1][:, :-1] + (x[:, i - 1, None] != y))
        d[i] = np.minimum.accumulate(t - step, axis=1) + step
    # all pairs walk back together: 1 takes a letter of both, 2 of a alone, 3 of b alone
    i, j, k = n.copy(), m.copy(), np.arange(len(a))
    ops = np.zeros((int((n + m).max(initial=0)), len(a)), np.uint8)
    for t in range(len(ops)):
        live = (i > 0) | (j > 0)
        if not live.any():
            break
        here, up, left = d[i, k, j], np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        both = (i > 0) & (j > 0) & (here == d[up, k, left] + (x[k, up] != y[k, left]))
        one = ~both & (i > 0) & (here == d[up, k, j] + 1)
        two = live & ~both & ~one
        ops[t] = both + 2 * one + 3 * two
        i, j = i - (both | one), j - (both | two)
    for r in range(len(a)):
        yield _walked(ops[:, r], x[r, : n[r]], y[r, : m[r]])


def events(a: str, b: str) -> tuple[int, int, int, int]:
    """(substitutions, indels of 1, of 2 or 3, of 4 or more) of an aligned pair."""
    subs, sizes, run, side = 0, [], 0, None
    for p, q in zip(a, b, strict=True):
        now = "a" if p == "-" else "b" if q == "-" else None
        if now != side and run:
            sizes.append(run)
            run = 0
        side = now
        if now:
            run += 1
        elif p != q:
            subs += 1
    if run:
        sizes.append(run)
    return subs, sum(s == 1 for s in sizes), sum(2 <= s <= 3 for s in sizes), sum(s >= 4 for s in sizes)


def run_of(text: str) -> list[tuple[int, int, str]]:
    """For each column the run of one base that it lies in, gaps bridged: (first run column, bases of the run, base)."""
    out: list = [None] * len(text)
    cols = [i for i, c in enumerate(text) if c != "-"]
    k = 0
    while k < len(cols):
        e = k
        while e + 1 < len(cols) and text[cols[e + 1]] == text[cols[k]]:
            e += 1
        for i in range(cols[k - 1] + 1 if k else 0, cols[e + 1] if e + 1 < len(cols) else len(text)):
            if out[i] is None or text[i] != "-":
                out[i] = (cols[k], e - k + 1, text[cols[k]])
        k = e + 1
    return [r or (0, 0, "-") for r in out]


def tags(a: str, b: str, least: int = 2) -> list[str]:
    """One tag per event of the candidate a against the reference b: a substitution, an indel, or a change of a run's length."""
    out, i = [], 0
    runs = run_of(b)
    while i < len(a):
        if a[i] != "-" and b[i] != "-":
            if a[i] != b[i]:
                out.append("non-hp-sub")
            i += 1
            continue
        side, e = ("a" if a[i] == "-" else "b"), i
        while e < len(a) and (a[e] == "-") == (side == "a") and (b[e] == "-") == (side == "b"):
            e += 1
        moved = b[i:e] if side == "a" else a[i:e]
        near = {(r[0], r[1], r[2]) for r in runs[i:e]}
        run = next(iter(near))
        if len(near) == 1 and run[1] >= least and set(moved) == {run[2]}:
            out.append(f"hp-l{run[1]}-{run[2]}-{'del' if side == 'a' else 'ins'}{e - i}")
        else:
            out.append("non-hp-indel")
        i = e
    return out


def _run_at(text: str, i: int) -> tuple[int, int, str]:
    """What `run_of` has for column i, from the columns around it."""
    j = i
    while j >= 0 and text[j] == "-":
        j -= 1
    if j < 0:
        j = i
        while j < len(text) and text[j] == "-":
            j += 1
        if j == len(text):
            return 0, 0, "-"
    c, first, n = text[j], j, 1
    for step in (-1, 1):
        k = j + step
        while 0 <= k < len(text) and text[k] in (c, "-"):
            if text[k] == c:
                n += 1
                first = min(first, k)
            k += step
    return first, n, c


def compared(a: str, b: str, least: int = 2, free: int = 6) -> tuple:
    """(edits, `events`, `tags`, the share of `run_free_distance`) of an aligned pair; only columns that differ are looked at."""
    at = [i for i, (p, q) in enumerate(zip(a, b, strict=True)) if p != q]
    subs, sizes, found, unscored, k = 0, [], [], 0, 0
    while k < len(at):
        i = at[k]
        if a[i] != "-" and b[i] != "-":
            subs += 1
            found.append("non-hp-sub")
            k += 1
            continue
        own, other = (a, b) if a[i] == "-" else (b, a)
        e = i
        while e < len(own) and own[e] == "-":
            e += 1
        k += e - i
        sizes.append(e - i)
        near = {_run_at(b, x) for x in range(i, e)}
        run, moved = next(iter(near)), set(other[i:e])
        if len(near) == 1 and run[1] >= least and moved == {run[2]}:
            found.append(f"hp-l{run[1]}-{run[2]}-{'del' if own is a else 'ins'}{e - i}")
        else:
            found.append("non-hp-indel")
        for x in range(i, e):
            mine, beside = _run_at(other, x), _run_at(own, x)
            unscored += max(mine[1], beside[1] if beside[2] == other[x] else 0) >= free
    scored = len(a) - unscored
    return len(at), subs, sum(x == 1 for x in sizes), sum(2 <= x <= 3 for x in sizes), sum(x >= 4 for x in sizes), found, (len(at) - unscored) / scored if scored else 0.0


def run_free_distance(a: str, b: str, least: int = 6) -> tuple[float, bool]:
    """(mismatching share of scored columns, whether nothing differs) of an aligned pair, indels inside runs of ``least`` bases or more being free."""
    runs_a, runs_b = run_of(a), run_of(b)
    scored = wrong = 0
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        if p == "-" or q == "-":
            base, run = (q, runs_b[i]) if p == "-" else (p, runs_a[i])
            other = runs_a[i] if p == "-" else runs_b[i]
            if base == run[2] and max(run[1], other[1] if other[2] == base else 0) >= least:
                continue
        scored += 1
        wrong += p != q
    return (wrong / scored if scored else 0.0), wrong == 0


_COUNTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("edits", "subs", "indel1", "indel3", "indel_long")] + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("run_distance", T.DoubleType())])


@F.pandas_udf(_COUNTS)
def differences(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """What differs between candidate and reference."""
    rows = [compared(p, q) for p, q in align(a.fillna("").tolist(), b.fillna("").tolist())]
    return pd.DataFrame(rows, columns=[f.name for f in _COUNTS])


@F.pandas_udf(T.IntegerType())
def infix_distance(pattern: pd.Series, text: pd.Series) -> pd.Series:
    """The fewest edits between the pattern and any part of the text; IUPAC codes in the pattern match their bases."""
    from ..functions.sequence import CODES

    mask = np.zeros(256, np.uint8)
    for c, m in CODES.items():
        mask[ord(c)] = mask[ord(c.lower())] = m
    out = []
    for s in _batches(pattern.tolist(), text.tolist()):
        x, n = _matrix(pattern[s].tolist(), 0)
        y, m = _matrix(text[s].tolist(), 0)
        step = np.arange(y.shape[1] + 1, dtype=np.int32)
        d = np.zeros((len(x), y.shape[1] + 1), np.int32)
        best = np.where(n == 0, 0, -1)
        for i in range(x.shape[1]):
            t = d + 1
            t[:, 1:] = np.minimum(t[:, 1:], d[:, :-1] + ((mask[x[:, i, None]] & mask[y]) == 0))
            d = np.minimum.accumulate(t - step, axis=1) + step
            done = n == i + 1
            if done.any():
                best[done] = np.where(step <= m[done, None], d[done], 1 << 30).min(axis=1)
        out += best.tolist()
    return pd.Series(out, dtype="int32")


def orientation(seq: Column, reverse: Column, forward_primer: str, reverse_primer: str, edits: int, window: int) -> Column:
    """'+' or '-' by which strand begins with the forward and ends with the complement of the reverse primer; null if neither or both do."""
    from ..functions.sequence import reverse_complement

    end = reverse_complement(F.lit(reverse_primer))
    hit = lambda s: (infix_distance(F.lit(forward_primer), F.substring(s, F.lit(1), F.lit(window))) <= edits).cast("int") + (infix_distance(end, F.substring(s, F.greatest(F.length(s) - window + 1, F.lit(1)), F.lit(window))) <= edits).cast("int")
    f, r = hit(seq), hit(reverse)
    return F.when((f > 0) & (r == 0), "+").when((r > 0) & (f == 0), "-")


def oriented(reads: DataFrame, seq: str, forward: str, reverse: str, edits: int, window: int) -> DataFrame:
    """``reads`` with strand, and the sequence turned where that is '-'; where it's unknown, as it was."""
    from ..functions.sequence import reverse_complement

    rc = reverse_complement(F.col(seq))
    r = reads.withColumn("strand", orientation(F.col(seq), rc, forward, reverse, edits, window))
    return r.withColumn(seq, F.when(F.col("strand") == "-", rc).otherwise(F.col(seq)))


def _masks() -> np.ndarray:
    from ..functions.sequence import CODES

    mask = np.zeros(256, np.uint8)
    for c, m in CODES.items():
        mask[ord(c)] = mask[ord(c.lower())] = m
    return mask


def _infix_row(pattern: np.ndarray, y: np.ndarray, anchored: bool) -> np.ndarray:
    """The last row of the matrices of a pattern against texts (base masks); anchored: from each text's start."""
    step = np.arange(y.shape[1] + 1, dtype=np.int32)
    d = np.repeat((step if anchored else np.zeros_like(step))[None], len(y), axis=0)
    for c in pattern:
        t = d + 1
        t[:, 1:] = np.minimum(t[:, 1:], d[:, :-1] + ((c & y) == 0))
        d = np.minimum.accumulate(t - step, axis=1) + step
    return d


def infix_spans(pattern: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the first best place of a pattern in each text, the longest that ends there."""
    mask = _masks()
    x = mask[np.frombuffer(pattern.encode("ascii", "replace"), np.uint8)]
    raw, size = _matrix(texts, 0)
    y = mask[raw]
    d = np.where(np.arange(y.shape[1] + 1) <= size[:, None], _infix_row(x, y, False), 1 << 30)
    end = d.argmin(axis=1)
    edits = d[np.arange(len(d)), end]
    back = np.zeros_like(y)
    for k, e in enumerate(end):
        back[k, :e] = y[k, :e][::-1]
    r = np.where(np.arange(y.shape[1] + 1) <= end[:, None], _infix_row(x[::-1], back, True), 1 << 30)
    long = y.shape[1] - r[:, ::-1].argmin(axis=1)
    return edits, end - long, end


_TRIMMED = T.StructType([T.StructField("seq", T.StringType()), T.StructField("primers", T.ArrayType(T.StringType()))])


def trimmed(seq: Column, primers: list[tuple[str, str]]) -> Column:
    """(seq, primers): the sequence without the best primer (fewest edits, the first of equals, a quarter of its length at most)
    within twice its length of either end, and what was found, as 5'-name and 3'-name."""

    @F.pandas_udf(_TRIMMED)
    def run(s: pd.Series) -> pd.DataFrame:
        texts = s.fillna("").tolist()
        n = len(texts)
        best = [[(1 << 30, None, 0)] * n, [(1 << 30, None, 0)] * n]
        for name, p in primers:
            for side, windows in enumerate(([t[: 2 * len(p)] for t in texts], [t[-2 * len(p) :] for t in texts])):
                if n:
                    for k, (e, a, b) in enumerate(zip(*infix_spans(p, windows), strict=True)):
                        if e <= len(p) // 4 and e < best[side][k][0]:
                            best[side][k] = (e, name, int(b) if side == 0 else len(texts[k]) - len(windows[k]) + int(a))
        out = []
        for k, t in enumerate(texts):
            (_, five, cut), (_, three, stop) = best[0][k], best[1][k]
            out.append((t[cut if five else 0 : stop if three else len(t)], [f"5'-{five}"] * bool(five) + [f"3'-{three}"] * bool(three)))
        return pd.DataFrame(out, columns=["seq", "primers"])

    return run(seq)
