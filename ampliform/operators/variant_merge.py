"""Variants of a group merge to ambiguity codes, the largest compatible subset first, again and again until none is left.

A round takes the ``batch`` largest free variants of every group, aligns them, and looks for the subset of the largest size whose differences stay
within the limits, those of earlier merges included. It becomes one record, and the batch is filled up; a batch that holds all
that is left of its group is finished at once. With overlaps (variants of different primers, of different extent) merged records
are tried once more, as a prefix and a suffix may meet in what joined them. All groups take a round together; a task
sees one batch, ``batch`` variants at most, and never a group.

Differences are counted as events: columns of several letters, and stretches of columns with gaps and letters. A stretch belongs to a run
if it has one base, which fills a column beside it, in runs of ``run`` bases in each variant; such an event is free unless ``strict``. Gaps beyond
a variant's ends don't count where extents differ.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import CODES, merge_batch
from .frames import FULL, place
from .overlap import overlaps
from .tables import cut, discard

_GAP = 45
_LETTER = {m: c for c, m in CODES.items()}


@dataclass(frozen=True)
class Limits:
    """What a merge may bring together: ``positions`` differences in all, none of several letters without ``snps``, no indel event longer than
    ``indel`` columns, no member below ``ratio`` of the subset's size; ``overlap`` bases in common (0: extents must not differ). A
    column stays if its letters have ``fraction`` of the size and ``floor`` at least."""

    positions: int = 2
    snps: bool = True
    indel: int = 0
    run: int = 1
    strict: bool = False
    overlap: int = 0
    ratio: float = 0.0
    fraction: float = 0.5
    floor: int = 3


def _profile(text: str) -> bytes:
    return b"".join(bytes(0 if c == b else FULL for b in "ACGT-") for c in text)


def align_few(texts: list[str], rounds: int = 2) -> np.ndarray:
    """The letters of a few sequences in common columns: aligned to the first, then to the columns' profile."""
    profile = _profile(texts[0])
    for _ in range(rounds):
        rows = _widened(list(place([profile] * len(texts), texts)))
        counts = np.stack([(rows == ord(b)).sum(axis=0) for b in "ACGT-"], axis=1)
        kept = counts[:, 4] < len(texts)
        rows = rows[:, kept]
        profile = np.round(FULL * (1 - counts[kept] / len(texts))).astype(np.uint8).tobytes()
    return rows


def _widened(placed: list[tuple[str, dict[int, str]]]) -> np.ndarray:
    size = len(placed[0][0])
    wide = [max(len(m.get(i, "")) for _, m in placed) for i in range(-1, size)]
    out = []
    for row, more in placed:
        # what stands before the first column ends there, all else begins at its place
        text = more.get(-1, "").rjust(wide[0], "-") + "".join(c + more.get(i, "").ljust(wide[i + 1], "-") for i, c in enumerate(row))
        out.append(np.frombuffer(text.encode("ascii", "replace"), np.uint8))
    return np.stack(out)


def align_overlapping(texts: list[str]) -> np.ndarray:
    """The letters of a few sequences of different extent, aligned to the longest by their overlaps."""
    centre = max(texts, key=len)
    placed = []
    for (p, q, n, m), t in zip(overlaps([centre] * len(texts), texts), texts, strict=True):
        a, b = p.replace("-", ""), q.replace("-", "")
        start, begin = centre.find(a) if n else 0, t.find(b) if m else 0
        row, more, at = ["-"] * len(centre), {}, start - 1
        for x, y in zip(p, q, strict=True):
            if x == "-":
                more[at] = more.get(at, "") + y
            else:
                at += 1
                row[at] = y
        if begin:
            more[start - 1] = t[:begin] + more.get(start - 1, "")
        if begin + m < len(t):
            more[at] = more.get(at, "") + t[begin + m :]
        placed.append(("".join(row), more))
    rows = _widened(placed)
    return rows[:, (rows != _GAP).any(axis=0)]


def _run_at(row: np.ndarray, low: int, high: int, base: int) -> int:
    """How many of ``base`` the row has in the run around columns low to high, gaps bridged."""
    n = int((row[low : high + 1] == base).sum())
    for step, i in ((-1, low - 1), (1, high + 1)):
        while 0 <= i < len(row) and row[i] in (base, _GAP):
            n += row[i] == base
            i += step
    return n


def differences(rows: np.ndarray, limits: Limits, overlapping: bool) -> dict[str, int]:
    """snps, indels and the longest of them, and the columns that all rows span."""
    solid = rows != _GAP
    first, last = solid.argmax(axis=1), rows.shape[1] - 1 - solid[:, ::-1].argmax(axis=1)
    low, high = (int(first.max()), int(last.min())) if overlapping else (0, rows.shape[1] - 1)
    gap, any_ = ~solid.all(axis=0), solid.any(axis=0)
    kinds = np.array([len(set(rows[solid[:, c], c].tolist())) for c in range(rows.shape[1])])
    inside = np.arange(rows.shape[1])
    inside = (inside >= low) & (inside <= high)
    out = {"snps": int((inside & ~gap & (kinds > 1)).sum()), "indels": 0, "longest": 0, "overlap": int((inside & ~gap).sum())}
    at = np.flatnonzero(inside & gap & any_)
    for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
        a, b = int(part[0]), int(part[-1])
        bases = {int(x) for x in rows[:, a : b + 1].ravel() if x != _GAP}
        beside = [c for c in (a - 1, b + 1) if 0 <= c < rows.shape[1] and not gap[c] and kinds[c] == 1]
        own = len(bases) == 1 and any(int(rows[0, c]) in bases for c in beside) and all(_run_at(r, a, b, next(iter(bases))) >= limits.run for r in rows)
        if limits.strict or not own:
            out["indels"] += 1
            out["longest"] = max(out["longest"], b - a + 1)
    return out


def merged_text(rows: np.ndarray, sizes: np.ndarray, limits: Limits, overlapping: bool) -> str:
    """The union of rows: in the columns that all span those whose letters weigh enough, beyond them all."""
    solid = rows != _GAP
    first, last = solid.argmax(axis=1), rows.shape[1] - 1 - solid[:, ::-1].argmax(axis=1)
    out = []
    for c in range(rows.shape[1]):
        spans = (first <= c) & (last >= c) if overlapping else np.ones(len(rows), bool)
        weight = sizes[solid[:, c]].sum()
        shared = not overlapping or first.max() <= c <= last.min()
        if weight and (not shared or weight >= limits.fraction * sizes[spans].sum() and weight >= limits.floor):
            out.append(_LETTER[functools.reduce(lambda m, x: m | CODES.get(chr(x), 0), rows[solid[:, c], c].tolist(), 0) or 15])
    return "".join(out)


def best_subset(batch: list[dict], limits: Limits) -> tuple[list[int], dict | None]:
    """(members, merged record) of the largest compatible subset of two or more variants; the first alone if there's none, or if the largest
    subset that passes is a single one."""
    if len(batch) == 1:
        return [0], None
    known = [set(v["primers"] or ()) for v in batch]
    overlapping = limits.overlap > 0 and any(known[0] and k and k != known[0] for k in known[1:])
    rows = align_overlapping([v["seq"] for v in batch]) if overlapping else align_few([v["seq"] for v in batch])
    size = [v["size"] for v in batch]
    subsets = [c for r in range(len(batch), 0, -1) for c in itertools.combinations(range(len(batch)), r)]
    for some in sorted(subsets, key=lambda c: -sum(size[i] for i in c)):
        total = sum(size[i] for i in some)
        if len(some) == 1:
            return list(some), None
        if limits.ratio and min(size[i] for i in some) < limits.ratio * total:
            continue
        own = rows[list(some)]
        d = differences(own[:, (own != _GAP).any(axis=0)], limits, overlapping)
        if overlapping and d["overlap"] < min(limits.overlap, *(len(batch[i]["seq"]) for i in some)):
            continue
        before = {k: sum(batch[i][k] for i in some) for k in ("snps", "indels")}
        if d["snps"] and not limits.snps or d["longest"] > limits.indel or d["snps"] + d["indels"] + sum(before.values()) > limits.positions:
            continue
        top = batch[min(some)]
        return list(some), top | {
            "seq": merged_text(own[:, (own != _GAP).any(axis=0)], np.array([size[i] for i in some]), limits, overlapping), "size": total, "ric": sum(batch[i]["ric"] for i in some), "snps": before["snps"] + d["snps"], "indels": before["indels"] + d["indels"],
            "primers": sorted(set().union(*(known[i] for i in some))), "members": [m for i in some for m in batch[i]["members"]], "overlapped": overlapping,
        }
    raise AssertionError("a single variant passes")


def packed(batch: list[dict], whole: bool, limits: Limits) -> Iterator[tuple[dict, list]]:
    """(record, names that it uses up) of a batch, by size; all of them if the batch is the whole of what is left."""
    batch = sorted(batch, key=lambda v: (-v["size"], v["name"]))
    while batch:
        some, record = best_subset(batch, limits)
        yield (record or batch[some[0]] | {"overlapped": False}), [batch[i]["name"] for i in some]
        batch = [v for i, v in enumerate(batch) if i not in some]
        if not whole:
            return


_STATE = ("name", "seq", "size", "ric", "primers", "snps", "indels", "members")
_FREE = (*_STATE, "most")


def merge_variants(variants: DataFrame, keys: list[str], name: str, seq: str, size: str, ric: str, primers: str, limits: Limits, batch: int = 6, effort: int | None = None) -> DataFrame:
    """(keys, name, seq, size, ric, primers, snps, indels, members): what is left when no subset merges any more; name is that of the largest
    member, members are the names of all. Variants without a sequence stay as they are. With an ``effort``, batches are as large as it allows
    a group of the size."""
    kind = variants.schema[name].dataType
    state = variants.select(*keys, F.col(name).alias("name"), F.upper(F.coalesce(seq, F.lit(""))).alias("seq"), F.col(size).cast("long").alias("size"), F.col(ric).cast("long").alias("ric"), F.coalesce(F.col(primers), F.array().cast("array<string>")).alias("primers"), F.lit(0).cast("long").alias("snps"), F.lit(0).cast("long").alias("indels"), F.array(name).alias("members"))
    most = F.lit(batch) if effort is None else merge_batch(F.count("*").over(Window.partitionBy(*keys)), effort).cast("int")
    state = state.withColumn("most", most)
    out = T.StructType([state.schema[c] for c in (*keys, *_FREE)] + [T.StructField("overlapped", T.BooleanType()), T.StructField("used", T.ArrayType(kind))])
    by = Window.partitionBy(*keys).orderBy(F.desc("size"), "name")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [dict(zip(_STATE, r, strict=True)) for r in pdf[list(_STATE)].itertuples(index=False)]
        for r in rows:
            r["primers"], r["members"] = list(r["primers"]), list(r["members"])
        own = pdf[keys].iloc[0].tolist()
        most = int(pdf["most"].iloc[0])
        found = [[*own, *(rec[c] for c in _STATE), most, rec["overlapped"], used] for rec, used in packed(rows, bool(pdf["left"].iloc[0] <= most), limits)]
        return pd.DataFrame(found, columns=out.names)

    finished = []
    free, silent = cut(state.where("seq <> ''")), state.where("seq = ''")
    while free.limit(1).count():
        done, again = [], free
        while again.limit(1).count():
            top = again.withColumn("place", F.row_number().over(by)).withColumn("left", F.count("*").over(Window.partitionBy(*keys)))
            got = cut(top.where(F.col("place") <= F.col("most")).groupBy(*keys).applyInPandas(run, out))
            used = got.select(*keys, F.explode("used").alias("name"))
            rest = cut(again.join(used, [*keys, "name"], "left_anti").select(*keys, *_FREE))
            if again is not free:
                discard(again)
            again = rest
            done.append(got)
        whole = cut(functools.reduce(DataFrame.union, done))
        discard(free, *done)
        # once more where overlaps merged and more than one record is left
        more = whole.groupBy(*keys).agg(F.max(F.col("overlapped")).alias("more"), F.count("*").alias("n")).where("more and n > 1").select(*keys)
        finished.append(whole.join(more, keys, "left_anti").select(*keys, *_STATE))
        free = cut(whole.join(more, keys, "left_semi").select(*keys, *_FREE))
    return functools.reduce(DataFrame.union, [*finished, silent.select(*keys, *_STATE)])
