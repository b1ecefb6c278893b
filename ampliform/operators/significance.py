"""How unlikely a variant is as sequencing error: binomial tails and the error rate at which it would no longer be."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHA = 1e-5


def log_tail(m: int, n: int, log_q: float) -> float:
    """ln P(X >= m) for X binomial (n, e**log_q); its first term where the others vanish."""
    if m <= 0:
        return 0.0
    if log_q >= 0:
        return 0.0
    k = np.arange(m, n + 1)
    log_p = math.log1p(-math.exp(log_q)) if log_q > -700 else 0.0
    choose = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in k])
    terms = choose + k * log_q + (n - k) * log_p
    top = terms.max()
    return min(0.0, float(top + math.log(np.exp(terms - top).sum())))


def log_critical(n: int, m: int, sites: int, k: int = 1, alpha: float = ALPHA) -> float | None:
    """ln q at which C(sites, k) * P(Bin(n, q) >= m) = alpha, by bisection; None if no rate can, inf if every rate does."""
    if not (0 < m <= n and sites > 0 and 0 < k <= sites):
        return None
    goal = math.log(alpha) - (math.lgamma(sites + 1) - math.lgamma(k + 1) - math.lgamma(sites - k + 1))
    low, high = -600.0, 0.0
    if log_tail(m, n, -1e-12) < goal:
        return math.inf
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if log_tail(m, n, mid) < goal else (low, mid)
    return (low + high) / 2


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma of each, by its series where x is large."""
    x = np.asarray(x, np.float64)
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):  # ln gamma(x) = ln gamma(x + 1) - ln x
        small = y < 8
        shift -= np.where(small, np.log(np.where(small, y, 1)), 0)
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y


def log_tails(m: np.ndarray, n: np.ndarray, log_q: np.ndarray) -> np.ndarray:
    """ln P(X >= m) for X binomial (n, e**log_q), 0 < m <= n: the continued fraction of the incomplete beta function, all at a time."""
    m, n, log_q = (np.asarray(v, np.float64) for v in (m, n, log_q))
    q = np.exp(np.minimum(log_q, 0))
    low = q < (m + 1) / (n + 3)  # else the other tail is the one that converges
    a, b = np.where(low, m, n - m + 1), np.where(low, n - m + 1, m)
    x = np.where(low, q, -np.expm1(np.minimum(log_q, 0)))
    log_x, log_y = np.where(low, log_q, np.log(np.maximum(x, 1e-300))), np.where(low, np.log1p(-np.minimum(q, 1 - 1e-16)), log_q)
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for i in range(1, max(400, int(5 * math.sqrt(n.max(initial=0))))):  # near the mean it takes the root of n
        for k in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            f *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    part = a * log_x + b * log_y + _lgamma(a + b) - _lgamma(a + 1) - _lgamma(b) + np.log(np.maximum(f, tiny))
    return np.minimum(0, np.where(low, part, np.log1p(-np.exp(np.minimum(part, -1e-16)))))


def log_criticals(n: np.ndarray, m: np.ndarray, sites: np.ndarray, k: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """`log_critical` of each, all bisected together; nan where there's none, infinite where every rate will do."""
    n, m, sites, k = (np.asarray(v, np.float64) for v in (n, m, sites, k))
    ok = (m > 0) & (m <= n) & (sites > 0) & (k > 0) & (k <= sites)
    n, m, sites, k = (np.where(ok, v, 1) for v in (n, m, sites, k))
    goal = math.log(alpha) - (_lgamma(sites + 1) - _lgamma(k + 1) - _lgamma(sites - k + 1))
    low, high = np.full(n.shape, -600.0), np.zeros(n.shape)
    never = log_tails(m, n, np.full(n.shape, -1e-12)) < goal
    for _ in range(80):
        mid = (low + high) / 2
        under = log_tails(m, n, mid) < goal
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return np.where(ok, np.where(never, np.inf, (low + high) / 2), np.nan)


@F.pandas_udf(T.DoubleType())
def log_tail_of(m: pd.Series, n: pd.Series, q: pd.Series) -> pd.Series:
    keys = pd.DataFrame({"m": m.astype("int64"), "n": n.astype("int64"), "q": q.astype("float64")})
    few = keys.drop_duplicates()
    known = few[(few["q"] > 0) & (few["m"] <= few["n"])]
    sure = (known["m"] <= 0) | (known["q"] >= 1)
    some = known[~sure]
    tail = pd.concat([pd.Series(0.0, known.index[sure]), pd.Series(log_tails(some["m"], some["n"], np.log(some["q"])) if len(some) else [], some.index, "float64")])
    return keys.merge(few.assign(tail=tail), how="left")["tail"].astype("float64")


@F.pandas_udf(T.DoubleType())
def log_critical_of(n: pd.Series, m: pd.Series, sites: pd.Series, k: pd.Series) -> pd.Series:
    keys = pd.DataFrame({"n": n, "m": m, "sites": sites, "k": k}).astype("int64")
    few = keys.drop_duplicates()
    few = few.assign(log_q=log_criticals(few["n"], few["m"], few["sites"], few["k"]) if len(few) else [])
    return keys.merge(few, how="left")["log_q"].astype("float64")


def per_position(log_q: Column, k: Column) -> Column:
    """The rate of one position of k."""
    return F.exp(log_q / k)


def factor(log_q: Column, log_expected: Column, k: Column) -> Column:
    """How many times the expected rates the critical rate is, per position; null where it isn't defined, infinite where any rate will do."""
    return F.when(log_q == float("inf"), float("inf")).otherwise(F.exp((log_q - log_expected) / k))
