"""Alignment of sequences that overlap: gaps at the ends are free, and what lies between is scored over runs.

Many pairs at a time, one numpy row of all their matrices a step. A match counts one, a difference takes one away, and so does each gap
within; the best part of the matrices' last row and column is where the overlap ends, and the walk back from there is where it
begins. Of equal ways a letter of both comes before a gap in the second sequence, then one in the first; of equal ends the one that
covers more comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pairwise import _batches, _masks, _matrix, align, events, run_of

#: Below this share of either sequence in its overlap, and beyond this many times the plain identity, adjusted identities aren't trusted.
LEAST_COVERAGE, MOST_GAIN = 0.5, 1.5


def overlaps(a: list[str], b: list[str]) -> Iterator[tuple[str, str, int, int]]:
    """(aligned a, aligned b, bases of a, bases of b) of the best overlap of each pair."""
    for s in _batches(a, b):
        yield from _overlaps(a[s], b[s])


def _overlaps(a: list[str], b: list[str]) -> Iterator[tuple[str, str, int, int]]:
    x, n = _matrix(a, 1)
    y, m = _matrix(b, 2)
    mask = _masks()
    fits = lambda p, q: (p == q) | (mask[p] & mask[q] == mask[p]) & (mask[p] > 0) | (mask[p] & mask[q] == mask[q]) & (mask[q] > 0)
    step = np.arange(y.shape[1] + 1, dtype=np.int32)
    d = np.zeros((x.shape[1] + 1, len(a), y.shape[1] + 1), np.int32)
    for i in range(1, len(d)):
        t = d[i - 1] - 1
        t[:, 0] = 0
        t[:, 1:] = np.maximum(t[:, 1:], d[i - 1][:, :-1] + np.where(fits(x[:, i - 1, None], y), 1, -1))
        d[i] = np.maximum.accumulate(t + step, axis=1) - step
    i, j, k = np.zeros(len(a), int), np.zeros(len(a), int), np.arange(len(a))
    for r in range(len(a)):
        p, q = np.arange(n[r] + 1), np.arange(m[r] + 1)
        score = np.concatenate([d[n[r], r, : m[r] + 1], d[: n[r] + 1, r, m[r]]])
        covers = np.concatenate([np.minimum(n[r], q), np.minimum(p, m[r])])
        best = int(np.lexsort((-np.arange(len(score)), covers, score))[-1])
        i[r], j[r] = (n[r], best) if best <= m[r] else (best - m[r] - 1, m[r])
    stop_i, stop_j = i.copy(), j.copy()
    ops = np.zeros((int((n + m).max(initial=0)), len(a)), np.uint8)
    for t in range(len(ops)):
        live = (i > 0) & (j > 0)
        if not live.any():
            break
        up, left = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        here = d[i, k, j]
        both = live & (here == d[up, k, left] + np.where(fits(x[k, up], y[k, left]), 1, -1))
        one = live & ~both & (here == d[up, k, j] - 1)
        two = live & ~both & ~one
        ops[t] = both + 2 * one + 3 * two
        i, j = i - (both | one), j - (both | two)
    for r in range(len(a)):
        o = ops[:, r]
        o = o[o > 0][::-1]
        p, q = np.full(len(o), 45, np.uint8), np.full(len(o), 45, np.uint8)
        p[o != 3], q[o != 2] = x[r, i[r] : stop_i[r]], y[r, j[r] : stop_j[r]]
        yield p.tobytes().decode("ascii", "replace"), q.tobytes().decode("ascii", "replace"), int(stop_i[r] - i[r]), int(stop_j[r] - j[r])


def _beside(text: str) -> tuple[list[int], list[int]]:
    """For each column the nearest column with a letter before it and after it, -1 if there's none."""
    before, after, last = [-1] * len(text), [-1] * len(text), -1
    for i, c in enumerate(text):
        before[i] = last
        last = i if c != "-" else last
    last = -1
    for i in range(len(text) - 1, -1, -1):
        after[i] = last
        last = i if text[i] != "-" else last
    return before, after


def run_identity(a: str, b: str, least: int) -> float:
    """The share of scored columns that agree: a base more in a run that both have is free, if the run has ``least`` bases in either; a base fits an
    ambiguity code that has it."""
    mask = _masks()
    sides = [(t, run_of(t), *_beside(t)) for t in (a, b)]
    scored = wrong = 0
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        if "-" in (p, q):
            (full, own, *_), (gapped, other, before, after) = sides if q == "-" else sides[::-1]
            size = max((other[k][1] for k in (before[i], after[i]) if k >= 0 and gapped[k] == full[i]), default=0)
            if size and max(size, own[i][1]) >= least:
                continue
        scored += 1
        u, v = int(mask[ord(p)]), int(mask[ord(q)])
        wrong += p != q and not (u and v and u & v in (u, v))
    return 1 - wrong / scored if scored else 1.0


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """An alignment without the gaps at its ends."""
    low = max(len(a) - len(a.lstrip("-")), len(b) - len(b.lstrip("-")))
    high = min(len(a.rstrip("-")), len(b.rstrip("-")))
    return a[low:high], b[low:high]


def adjusted_distances(a: list[str], b: list[str], least: int) -> list[float]:
    """Distances over the whole sequences, runs adjusted; the plain one where the overlap is too small to go by."""
    out = []
    for (p, q), x, y in zip(align(a, b), a, b, strict=True):
        if not x or not y:
            out.append(1.0)
        elif x == y:
            out.append(0.0)
        else:
            plain = 1 - sum(u != v for u, v in zip(p, q, strict=True)) / max(len(x), len(y))
            u, v = _trimmed(p, q)
            share = min(len(u.replace("-", "")) / len(x), len(v.replace("-", "")) / len(y))
            adjusted = run_identity(u, v, least)
            out.append(1 - plain if share < LEAST_COVERAGE or plain > 0 and adjusted > plain * MOST_GAIN else 1 - adjusted)
    return out


def overlap_distances(a: list[str], b: list[str], overlap: int, least: int) -> list[float]:
    """Distances within the overlap, if it has ``overlap`` bases of both or all of the shorter one; else those over the whole sequences."""
    out: list[float] = [1.0] * len(a)
    some = [i for i in range(len(a)) if a[i] and b[i]]
    short = []
    for i, (p, q, n, m) in zip(some, overlaps([a[i] for i in some], [b[i] for i in some]), strict=True):
        if a[i] == b[i]:
            out[i] = 0.0
        elif min(n, m) >= min(overlap, len(a[i]), len(b[i])):
            out[i] = 1 - run_identity(p, q, least)
        else:
            short.append(i)
    for i, d in zip(short, adjusted_distances([a[i] for i in short], [b[i] for i in short], least), strict=True):
        out[i] = d
    return out


def overlap_distance(overlap: int, least: int = 1):
    """A function of two sequence columns."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(overlap_distances(a.fillna("").str.upper().tolist(), b.fillna("").str.upper().tolist(), overlap, least), dtype="float64")

    return run


def adjusted_distance(least: int = 1):
    """The same over the whole sequences."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(adjusted_distances(a.fillna("").str.upper().tolist(), b.fillna("").str.upper().tolist(), least), dtype="float64")

    return run


def summary(a: str, b: str) -> str:
    """What differs between two aligned sequences, in words; letters that agree by an ambiguity code don't."""
    mask = _masks()
    alike = lambda p, q: p == q or "-" not in (p, q) and int(mask[ord(p)]) & int(mask[ord(q)]) in (int(mask[ord(p)]), int(mask[ord(q)]))
    subs, one, short, long = events(a, "".join(p if alike(p, q) else q for p, q in zip(a, b, strict=True)))
    said = [f"{n} {what}{'s' * (n != 1)}" for n, what in ((subs, "substitution"), (one, "single-nt indel"), (short, "short (<= 3nt) indel"), (long, "long indel")) if n]
    return ", ".join(said) or "identical sequences (IUPAC-compatible)"


@F.pandas_udf(T.StringType())
def variant_summary(a: pd.Series, b: pd.Series) -> pd.Series:
    """How a variant differs from the primary sequence of its group."""
    x, y = a.fillna("").tolist(), b.fillna("").tolist()
    out = ["sequences empty - cannot compare" if not p or not q else "identical sequences" if p == q else "" for p, q in zip(x, y, strict=True)]
    some = [i for i, o in enumerate(out) if not o]
    for i, (p, q) in zip(some, align([x[i] for i in some], [y[i] for i in some]), strict=True):
        out[i] = summary(p, q)
    return pd.Series(out, dtype="object")
