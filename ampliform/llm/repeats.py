"""Suffix-array dedup: maximal repeats of at least ``need`` bytes from the common-prefix intervals of suffix arrays.

The suffix array is sparse and bucketed. Of the hashes of all GRAM-byte strings, those smallest in some window of
need - GRAM + 1 neighbours are anchors: any two equal strings of ``need`` bytes hold the same anchors, so only
suffixes that begin at an anchor are needed, and suffixes with the same first GRAM bytes are a bucket. Buckets
with one suffix are dropped in the first exchange. Suffixes whose whole context (from need - GRAM bytes before the
anchor to need bytes after its start) is equal are one context. A bucket with several contexts becomes an enhanced suffix array:
contexts sorted by what follows, the common prefixes of neighbours, and a stack scan that gives the interval tree. In
each interval the contexts are ordered by what precedes them; intervals of that order are the sets with one left
extension, maximal as their left ends differ, and each with total length ``need`` or more is a repeat group with all its
occurrences.

A bucket of more than ``CONTEXTS`` contexts is split by the bytes around it before it is exchanged: part i holds the
contexts that agree in ``STEP`` * i bytes before the anchor and in the need - ``STEP`` * (i + 1) bytes from its start.
A repeat with L bytes before the anchor is whole in part L // ``STEP`` (the last part takes longer ones), so each part is
scanned by itself. Contexts of a part
that is still larger agree in all but ``STEP`` bytes of a repeat: the tree's nodes left below are strings of ``need`` bytes,
and they are dealt by their hash and counted, so no part is ever one task's beyond the bound.

What is removed is the union of all occurrences, judged on the input. Equal texts are one text here; a text with
copies is removed whole if it has ``need`` bytes. Bytes are compared wherever contexts are; strings are the same bucket by a
64-bit hash, the same context by two.

Edge cases: null and shorter texts lose nothing; matches never cross rows, but may lie in one row; rows that repeat a
doc_id are texts of their own; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, cut, group_rows, mix, pieces, prefix_hash, utf8
from .exact_dedup import lookup, repeated_filter

#: Bytes of a repeat, bytes of an anchor, contexts of a bucket or part that one task takes, bytes by which parts differ.
NEED, GRAM, CONTEXTS, STEP = 400, 200, 4000, 100


def _slide(v: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w neighbours; as long as v, the last w - 1 take what is left."""
    pad = np.full(-len(v) % w + w, v[-1] if op is np.minimum else 0, v.dtype)
    x = np.concatenate([v, pad])
    blocks = x.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: len(v)], ahead[w - 1 : w - 1 + len(v)])


class Anchors:
    """The anchors of a run of texts: row (which text), at (byte in the text), h, ctx, and before, after: bytes of context."""

    def __init__(self, data: bytes, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, offset: np.ndarray):
        """Texts [start, end) of data; windows from low to high - 1 count; offset: what to add to a place for the text's own."""
        self.data = np.frombuffer(data, np.uint8)
        w = NEED - GRAM + 1
        p, down = prefix_hash(self.data)
        if len(self.data) < NEED:
            keep = np.empty(0, np.int64)
        else:
            grams = mix((p[GRAM:] - p[:-GRAM]) * down[: len(p) - GRAM])
            least = _slide(grams, w, np.minimum)
            inside = np.zeros(len(grams) + 1, np.int32)
            on = high > low
            np.add.at(inside, low[on], 1)
            np.add.at(inside, np.minimum(high[on], len(grams)), -1)
            least[np.cumsum(inside[:-1]) == 0] = 0
            most = _slide(least[::-1], w, np.maximum)[::-1]
            keep = np.flatnonzero(most == grams)
        self.row = np.searchsorted(start, keep, side="right") - 1
        self.left = np.maximum(start[self.row], keep + GRAM - NEED)
        self.right = np.minimum(end[self.row], keep + NEED)
        self.before, self.after = keep - self.left, self.right - keep
        self.h = grams[keep].view(np.int64) if len(keep) else np.empty(0, np.int64)
        whole = (p[self.right] - p[self.left]) * down[self.left]
        self.ctx = mix(whole + self.before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.after.astype(np.uint64)).view(np.int64)
        self.at = keep + offset[self.row]
        self.place, self.p, self.down = keep, p, down


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, Anchors]]:
    """(number of each text, anchors) for runs of texts of ``NEED`` bytes or more, and slices of long ones."""
    run, size = [], 0

    def flush() -> Iterator[tuple[np.ndarray, Anchors]]:
        if run:
            n = np.array([len(texts[i]) for i in run])
            end = np.cumsum(n)
            start = end - n
            yield np.array(run), Anchors(b"".join(texts[i] for i in run), start, end, start, end - NEED + 1, -start)

    for i, t in enumerate(texts):
        if len(t) > SLICE:
            for s in range(0, len(t) - NEED + 1, SLICE):
                a, b = max(0, s - NEED), min(len(t), s + SLICE + 2 * NEED)
                one = lambda x: np.array([x])
                yield one(i), Anchors(t[a:b], one(0), one(b - a), one(s - a), one(min(s + SLICE, len(t) - NEED + 1) - a), one(a))
        elif len(t) >= NEED:
            if size + len(t) > SLICE:
                yield from flush()
                run, size = [], 0
            run.append(i)
            size += len(t)
    yield from flush()


def text_id(text: bytes) -> int:
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "little", signed=True)


def _new(texts: list[bytes], seen: set[int]) -> tuple[list[bytes], np.ndarray]:
    """Texts not met before in this partition, with their ids."""
    ids = [text_id(t) for t in texts]
    fresh = [i for i, k in enumerate(ids) if k not in seen and not seen.add(k) and len(texts[i]) >= NEED]
    return [texts[i] for i in fresh], np.array([ids[i] for i in fresh], np.int64)


_PACKED = ("h", "ctx", "t", "at", "before", "after")
_KINDS = {"h": np.int64, "ctx": np.int64, "t": np.int64, "at": np.int64, "before": np.uint16, "after": np.uint16}


def _suffixes(docs: DataFrame, buckets: int) -> DataFrame:
    """The anchors of all distinct texts, packed, dealt by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in pieces(batches):
            texts, ids = _new(utf8(b.column(1)), seen)
            parts = [{"h": a.h, "ctx": a.ctx, "t": ids[rows[a.row]], "at": a.at, "before": a.before, "after": a.after} for rows, a in anchors(texts)]
            if not parts:
                continue
            both = {k: np.concatenate([p[k] for p in parts]).astype(_KINDS[k]) for k in _PACKED}
            out = list(group_rows(both, (mix(both["h"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), *(pa.array([v[c].tobytes() for _, v in out], pa.binary()) for c in _PACKED)], names=["bucket", *_PACKED])

    return docs.mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in _PACKED))


def _same_contexts(packed: DataFrame) -> DataFrame:
    """Of each bucket with two suffixes or more: kind 0, (h, ctx, t, at, a, b) of a suffix whose whole context [a, b) repeats;
    kind 1, (h, a: number of contexts) if it has several."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = {c: np.frombuffer(b"".join(pdf[c]), _KINDS[c]) for c in _PACKED}
        order = np.lexsort((v["at"], v["t"], v["ctx"], v["h"]))
        v = {c: x[order] for c, x in v.items()}
        new = np.ones(len(order), bool)
        new[1:] = (v["h"][1:] != v["h"][:-1]) | (v["ctx"][1:] != v["ctx"][:-1]) | (v["t"][1:] != v["t"][:-1]) | (v["at"][1:] != v["at"][:-1])
        v = {c: x[new] for c, x in v.items()}
        first = np.ones(len(v["h"]), bool)
        first[1:] = (v["h"][1:] != v["h"][:-1]) | (v["ctx"][1:] != v["ctx"][:-1])
        n = np.diff(np.append(np.flatnonzero(first), len(first)))
        on = np.repeat(n > 1, n)
        h, contexts = np.unique(v["h"][first], return_counts=True)
        several = contexts > 1
        none = np.zeros(several.sum(), np.int64)
        both = lambda x, y: np.concatenate([x, y])
        return pd.DataFrame({
            "kind": np.repeat([0, 1], [on.sum(), several.sum()]).astype(np.int32), "h": both(v["h"][on], h[several]), "ctx": both(v["ctx"][on], none), "t": both(v["t"][on], none),
            "at": both(v["at"][on], none), "a": both(v["at"][on] - v["before"][on], contexts[several]), "b": both(v["at"][on] + v["after"][on], none),
        })

    return packed.groupBy("bucket").applyInPandas(run, "kind int, h long, ctx long, t long, at long, a long, b long")


def _common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of each interval of the tree over len(lcp) + 1 sorted strings, by a stack scan."""
    stack: list[list[int]] = []
    for i, v in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > v:
            depth, first = stack.pop()
            yield depth, first, i
        if v and (not stack or stack[-1][0] < v):
            stack.append([v, first])


def maximal_repeats(lefts: list[bytes], rights: list[bytes], need: int = NEED) -> Iterator[tuple[list[int], int, int]]:
    """(contexts, left length, right length) of each maximal repeat: lefts are reversed, from the anchor backwards."""
    n = len(rights)
    if n == 2:
        left, right = _common(lefts[0], lefts[1]), _common(rights[0], rights[1])
        if left + right >= need:
            yield [0, 1], left, right
        return
    order = sorted(range(n), key=rights.__getitem__)
    lcp = [_common(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    by_left = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    between = np.array([_common(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:], strict=False)])
    for right, first, last in _intervals(lcp):
        if right < GRAM:
            continue  # another anchor with the same hash
        ranks = np.sort([rank[i] for i in order[first : last + 1]])
        shared = np.minimum.reduceat(between, ranks[:-1]) if ranks[-1] == n - 1 else np.minimum.reduceat(between, ranks)[:-1]
        if shared.max() + right < need:
            continue
        # one more than the left length, as an interval of length 0 counts too
        for left, a, b in _intervals([int(x) + 1 if x + right >= need else 0 for x in shared]):
            yield [by_left[r] for r in ranks[a : b + 1]], left - 1, right


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _parts(h: int, left: bytes, right: bytes) -> Iterator[tuple[int, int]]:
    """(i, part) of each part of a large bucket that a context belongs to; left reversed, from the anchor backwards."""
    for i in range((NEED - GRAM) // STEP):
        before, after = STEP * i, max(GRAM, NEED - STEP * (i + 1))
        if len(left) >= before and len(right) >= after:
            yield i, _hash(b"%d %d " % (h, i) + left[:before] + b"|" + right[:after])


def _contexts(texts: DataFrame, maybe, large, buckets: int) -> DataFrame:
    """(bucket, part, i, h, ctx, t, at, left, right): one suffix of each context of the buckets with several; a large bucket's
    contexts once in each of their parts. i is -1 in buckets that are not split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        met: set[tuple[int, int]] = set()
        names = ["bucket", "part", "i", "h", "ctx", "t", "at", "left", "right"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.binary()]
        for b in pieces(batches):
            new, ids = _new(utf8(b.column(1)), seen)
            out = []
            for rows, a in anchors(new):
                at = np.flatnonzero(maybe(a.h))
                for j, split in zip(at, large(a.h[at]), strict=True):
                    key = (int(a.h[j]), int(a.ctx[j]))
                    if key in met:
                        continue
                    met.add(key)
                    place = a.place[j]
                    left, right = a.data[a.left[j] : place].tobytes()[::-1], a.data[place : a.right[j]].tobytes()
                    for i, part in _parts(key[0], left, right) if split else ((-1, key[0]),):
                        out.append((part % buckets, part, i, *key, int(ids[rows[a.row[j]]]), int(a.at[j]), left, right))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    return texts.mapInArrow(run, "bucket int, part long, i int, h long, ctx long, t long, at long, left binary, right binary")


def _scanned(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, int, list[int], int, int]]:
    """(its rows, i, members, left, right) of each maximal repeat of each part in ``pdf``."""
    pdf = pdf.drop_duplicates(["part", "h", "ctx"]).sort_values(["part", "h", "ctx"], kind="stable")
    part, i, lefts, rights = (pdf[c].to_numpy() for c in ("part", "i", "left", "right"))
    rows = pdf.index.to_numpy()
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edges], [*edges, len(part)], strict=True):
        if b - a > 1:
            for members, left, right in maximal_repeats(list(lefts[a:b]), list(rights[a:b])):
                if i[a] in (-1, min(left // STEP, (NEED - GRAM) // STEP - 1)):  # a repeat counts in its own part
                    yield rows[a:b], int(i[a]), members, left, right


def _forced(data: bytes, at: int) -> bool:
    """Whether the anchor at ``at`` is one wherever ``data`` stands: whether it's the smallest of some window inside."""
    p, down = prefix_hash(np.frombuffer(data, np.uint8))
    grams = mix((p[GRAM:] - p[:-GRAM]) * down[: len(p) - GRAM])
    least = _slide(grams, NEED - GRAM + 1, np.minimum)[: len(data) - NEED + 1]
    return bool((least[max(0, at - NEED + GRAM) : at + 1] == grams[at]).any())


def _groups_of(contexts: DataFrame) -> DataFrame:
    """(part, repeat, length, h, ctx, before, full): the contexts of each maximal repeat, which begins so many bytes before the
    anchor; full: the repeat is the whole context."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, pdf = [], pdf.reset_index(drop=True)
        part, h, ctx = (pdf[c].to_numpy() for c in ("part", "h", "ctx"))
        size = pdf["left"].str.len().to_numpy(), pdf["right"].str.len().to_numpy()
        lefts, rights = pdf["left"].to_numpy(), pdf["right"].to_numpy()
        for k, (rows, _, members, left, right) in enumerate(_scanned(pdf)):
            one = rows[members[0]]
            if not _forced(lefts[one][:left][::-1] + rights[one][:right], left):
                continue  # it comes with another anchor, at which all its occurrences meet
            out += [(part[r], k, left + right, h[r], ctx[r], left, int((size[0][r], size[1][r]) == (left, right))) for r in rows[members]]
        return pd.DataFrame(out, columns=["part", "repeat", "length", "h", "ctx", "before", "full"], dtype="int64")

    return contexts.select("bucket", "part", "i", "h", "ctx", "left", "right").groupBy("bucket").applyInPandas(run, "part long, repeat long, length long, h long, ctx long, before long, full long")


def _extents_of(contexts: DataFrame) -> DataFrame:
    """(t, a, b): for each context the bytes from the first to the last that some repeat around its anchor covers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        before, after = np.full(len(pdf), -1), np.zeros(len(pdf), np.int64)
        for rows, _, members, left, right in _scanned(pdf):
            m = rows[members]
            before[m] = np.maximum(before[m], left)
            after[m] = np.maximum(after[m], right)
        on = before >= 0
        at = pdf["at"].to_numpy()[on]
        return pd.DataFrame({"t": pdf["t"].to_numpy()[on], "a": at - before[on], "b": at + after[on]})

    return contexts.select("bucket", "part", "i", "h", "ctx", "t", "at", "left", "right").groupBy("bucket").applyInPandas(run, "t long, a long, b long")


def _strings(contexts: DataFrame, buckets: int) -> DataFrame:
    """(t, a, b): strings of ``NEED`` bytes around the anchors of large parts that several contexts hold, dealt by their hash."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            parts = []
            for t, at, left, right in zip(*(b.column(c).to_pylist() for c in ("t", "at", "left", "right")), strict=True):
                data = np.frombuffer(left[::-1] + right, np.uint8)
                s = np.arange(0, min(len(left), len(data) - NEED) + 1)
                if len(s):
                    p, down = prefix_hash(data)
                    parts.append((mix((p[s + NEED] - p[s]) * down[s]), np.full(len(s), t, np.int64), s + (at - len(left))))
            w = {k: np.concatenate([x[i] for x in parts]) if parts else np.empty(0, np.uint64 if k == "h" else np.int64) for i, k in enumerate("hts")}
            out = list(group_rows(w, (w["h"] % np.uint64(buckets)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), *(pa.array([v[c].tobytes() for _, v in out], pa.binary()) for c in "hts")], names=["bucket", *"hts"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, t, s = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in zip("hts", (np.uint64, np.int64, np.int64), strict=True))
        order = np.lexsort((s, t, h))
        h, t, s = h[order], t[order], s[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        h, t, s = h[new], t[new], s[new]
        on = np.zeros(len(h), bool)
        on[1:] = h[1:] == h[:-1]
        on[:-1] |= h[1:] == h[:-1]
        t, s = t[on], s[on]
        order = np.lexsort((s, t))
        t, s = t[order], s[order]
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (s[1:] - s[:-1] > NEED)  # neighbours in one task go on as one row
        last = np.append(first[1:], True) if len(t) else first
        return pd.DataFrame({"t": t[first], "a": s[first], "b": s[last] + NEED})

    packed = contexts.select("t", "at", "left", "right").mapInArrow(spread, "bucket int, h binary, t binary, s binary")
    return packed.groupBy("bucket").applyInPandas(run, "t long, a long, b long")


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))


def _plan(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(suffixes whose whole contexts repeat, contexts of parts that one task may take, contexts of larger parts)."""
    spark = texts.sparkSession
    size = texts.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    buckets = max(16, size // 20_000_000)
    first = cut(_same_contexts(_suffixes(texts, buckets)))
    several = first.where("kind = 1").select(F.col("h").alias("key"), "a")
    sieve = lambda keys: lookup(spark, repeated_filter(keys.union(keys), 2 * keys.count()))
    maybe, large = sieve(several.select("key")), sieve(several.where(F.col("a") > CONTEXTS).select("key"))
    contexts = cut(_contexts(texts, maybe, large, 4 * buckets))
    sizes = contexts.where("i >= 0").groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > CONTEXTS).select("part")
    if sizes.limit(1).count() == 0:
        return first.where("kind = 0").drop("kind"), contexts, contexts.limit(0)
    over = cut(sizes)
    return first.where("kind = 0").drop("kind"), contexts.join(over, "part", "left_anti"), contexts.join(over, "part", "left_semi").dropDuplicates(["h", "ctx"])


def repeat_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(part, repeat, length, text_id, start): the maximal repeats of ``NEED`` bytes or more, each with all its occurrences in distinct
    texts, as far as a context reaches around an anchor: a longer one comes once for each anchor in it. Repeats
    of parts too large to scan come as their contexts' whole repeats alone; `spans` has what they cover."""
    same, contexts, _ = _plan(_texts(docs, text, doc_id))
    contexts = cut(contexts)
    every = contexts.select("h", "ctx", "t", "at").union(same.select("h", "ctx", "t", "at")).distinct()
    groups = cut(_groups_of(contexts))
    found = groups.join(every, ["h", "ctx"]).select("part", "repeat", "length", F.col("t").alias("text_id"), (F.col("at") - F.col("before")).alias("start"))
    # contexts that repeat as wholes, named by the context, unless another context holds them too
    whole = same.join(groups.where("full = 1").select("h", "ctx"), ["h", "ctx"], "left_anti").where(F.col("b") - F.col("a") >= NEED).select(F.col("ctx").alias("part"), F.lit(-1).cast("long").alias("repeat"), (F.col("b") - F.col("a")).alias("length"), F.col("t").alias("text_id"), F.col("a").alias("start"))
    return found.union(whole).distinct()


def _merged(covered: DataFrame, buckets: int) -> DataFrame:
    """(text_id, spans array of (a, b)): overlapping and touching spans of a text as one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "a"], kind="stable")
        t, a, b = (pdf[c].to_numpy() for c in "tab")
        reach = pdf.groupby("t")["b"].cummax().to_numpy()
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (a[1:] > reach[:-1])
        last = np.append(first[1:], True)
        t, a, b = t[first], a[first], reach[last]
        edges = np.flatnonzero(np.diff(t)) + 1
        return pd.DataFrame({"text_id": t[np.concatenate([[0], edges])], "spans": [[{"a": x, "b": y} for x, y in zip(p, q, strict=True)] for p, q in zip(np.split(a, edges), np.split(b, edges), strict=True)]})

    dealt = covered.withColumn("to", F.pmod(F.xxhash64("t"), F.lit(buckets)))
    return dealt.groupBy("to").applyInPandas(run, "text_id long, spans array<struct<a: bigint, b: bigint>>")


def spans(texts: DataFrame) -> DataFrame:
    """(text_id, spans array of (a, b)): the bytes to remove of each distinct text, merged."""
    same, contexts, large = _plan(texts)
    covered = cut(same.select("t", "a", "b").union(_extents_of(contexts)).union(_strings(large, 64)))
    return _merged(covered, max(16, covered.count() // 20_000))


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bytes_too: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (with ``bytes_too`` the remaining bytes; null if all of the
    text remains) of each row."""
    texts = _texts(docs, text, doc_id)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            t = utf8(b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([text_id(x) for x in t], pa.int64()), pa.array([len(x) for x in t], pa.int64())], names=["text_id", "n"])

    classes = texts.mapInArrow(ids, "text_id long, n long").groupBy("text_id").agg(F.count("*").alias("copies"), F.max("n").alias("n"))
    copies = classes.where(f"copies > 1 and n >= {NEED}").select("text_id", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))).alias("whole"))
    gone = cut(spans(texts).join(copies, "text_id", "full").select("text_id", F.coalesce("whole", "spans").alias("spans")))
    keys = gone.select(F.col("text_id").alias("key"))
    maybe = lookup(texts.sparkSession, repeated_filter(keys.union(keys), 2 * gone.count()))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            t = utf8(b.column(1))
            k = np.array([text_id(x) for x in t], np.int64)
            hit = maybe(k)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(k), pa.array([len(x) for x in t], pa.int64()),
                pa.array([x if y else None for x, y in zip(t, hit, strict=True)], pa.binary()),
                pa.array([None if y else hashlib.sha256(x).hexdigest() for x, y in zip(t, hit, strict=True)], pa.string()),
            ], names=["doc_id", "text_id", "n_bytes", "raw", "kept_sha256"])

    routed = texts.mapInArrow(route, "doc_id long, text_id long, n_bytes long, raw binary, kept_sha256 string")
    zero = F.lit(0).cast("long")
    straight = routed.where("raw is null").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", F.lit(None).cast("binary").alias("kept"))
    touched = routed.where("raw is not null").select("doc_id", "text_id", "n_bytes", "raw").join(gone, "text_id", "left").select("doc_id", "n_bytes", "raw", "spans")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n, k, sha, kept = [], [], [], []
            for raw, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                edges = [0, *(e for x in s or () for e in (x["a"], x["b"])), len(raw)]
                rest = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                n.append(len(raw) - len(rest))
                k.append(len(s or ()))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if s and bytes_too else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return straight.union(touched.mapInArrow(take, schema))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(spark.read.parquet(f"{sf_dir}/documents.parquet"), bytes_too=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
