"""Exact deduplication: two-pass Bloom filtering.

Pass one digests every text and adds its key to a counting Bloom filter whose counters stop at two. Pass two
looks each key up: a row of which some counter is below two is unique for certain and passes straight through;
only the others, the possibly repeated, are shuffled by their full digest and compared exactly. False positives
of the filter cost a shuffled row each and never change a result.

The filter has ``BITS_PER_KEY`` counters a key whatever the number of rows, in segments of 2**``SEGMENT`` counters at
most (one bit each once merged): rows lie in folders by the segment of their key, and each segment is counted, sent to
the executors and looked up by its own rows alone. So what is broadcast has a fixed bound, and the share of rows that
shuffle without need stays small at any size. A hot text is counted per partition before the
filter's shuffle, aggregated map-side before its group's, and its rows meet their keeper by broadcast: groups of at least
a ``HOT``-th of all rows are ``HOT`` at most.

Edge cases: a null text is the empty text; texts of white space alone equal the empty text. A null doc_id loses
against any other. Rows that repeat a doc_id with an equal text are one document: `decisions` marks each of
them as kept, `keep_first` returns one of them. An empty table gives an empty result. Other columns, whatever
their names, are left alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh

#: Counters of a segment of the filter at most (16 MB once merged), counters for each key, counters of a merged piece, and
#: the share of all rows, one in so many, from which a group is hot.
SEGMENT, BITS_PER_KEY, PIECE_BITS, HOT = 27, 16, 16, 10_000

_BLANKS = " \t\n\x0b\x0c\r"


def sha256(text: Column) -> Column:
    """The digest of a text without white space, in hexadecimal digits."""
    return F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), _BLANKS, ""), 256)


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_sha256, key, chars) of each row: key is a hash of the digest."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), sha256(F.col(text)).alias("text_sha256"), F.length(t).cast("long").alias("chars"))
    return d.select("doc_id", "text_sha256", F.xxhash64("text_sha256").alias("key"), "chars")


def _positions(key: np.ndarray, bits: int) -> list[np.ndarray]:
    k, m = key.view(np.uint64), np.uint64((1 << bits) - 1)
    return [(k & m).astype(np.int64), ((k >> np.uint64(32)) & m).astype(np.int64)]


def repeated_filter(keys: DataFrame, rows: int, segment: int = SEGMENT) -> tuple[int, dict[int, bytes]]:
    """(bits, bitmap by piece): the counters, 2**``segment`` at most, that two or more rows of ``keys`` (key long) reached."""
    bits = min(segment, max(PIECE_BITS, (max(1, rows) * BITS_PER_KEY - 1).bit_length()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, list[np.ndarray]] = {}

        def drain() -> pd.DataFrame:
            out = []
            for seg, parts in seen.items():
                at, n = np.unique(np.concatenate(parts), return_counts=True)
                out.append((seg, at[n == 1].astype(np.uint16).tobytes(), at[n > 1].astype(np.uint16).tobytes()))
            seen.clear()
            return pd.DataFrame(out, columns=["seg", "once", "more"])

        held = 0
        for pdf in batches:
            pos = np.concatenate(_positions(pdf["key"].to_numpy(np.int64), bits))
            pos = np.sort(pos)
            seg, at = pos >> PIECE_BITS, pos & ((1 << PIECE_BITS) - 1)
            cuts = np.flatnonzero(np.diff(seg)) + 1
            for s, a in zip(seg[np.concatenate([[0], cuts])] if len(seg) else [], np.split(at, cuts), strict=False):
                seen.setdefault(int(s), []).append(a)
            held += len(pos)
            if held > 4_000_000:
                yield drain()
                held = 0
        yield drain()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(1 << PIECE_BITS, np.uint8)
        for once, more in zip(pdf["once"], pdf["more"], strict=True):
            at = np.frombuffer(once, np.uint16)
            n[at] = np.minimum(n[at] + 1, 2)
            n[np.frombuffer(more, np.uint16)] = 2
        return pd.DataFrame({"seg": pdf["seg"].iloc[:1], "bitmap": [np.packbits(n > 1, bitorder="little").tobytes()]}) if (n > 1).any() else pd.DataFrame({"seg": pd.Series([], dtype="int32"), "bitmap": pd.Series([], dtype=object)})

    parts = keys.select("key").mapInPandas(count, "seg int, once binary, more binary")
    merged = parts.groupBy("seg").applyInPandas(merge, "seg int, bitmap binary")
    return bits, {r.seg: bytes(r.bitmap) for r in merged.toLocalIterator()}


def lookup(spark: SparkSession, found: tuple[int, dict[int, bytes]]):
    """A function from an array of keys to booleans: whether each key may be repeated."""
    bits, segments = found
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for seg, bitmap in segments.items():
        whole[seg << (PIECE_BITS - 3) : (seg + 1) << (PIECE_BITS - 3)] = np.frombuffer(bitmap, np.uint8)
    shared = spark.sparkContext.broadcast(whole)

    def maybe(key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), bool)
        for pos in _positions(np.ascontiguousarray(key, np.int64), bits):
            out &= (shared.value[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1
        return out

    maybe.forget = shared.unpersist
    return maybe


def _in_segments(rows: DataFrame, total: int, segment: int, key: str = "key") -> list[DataFrame]:
    """``rows`` by segments of the filter, one frame if one is enough."""
    n = -(-total * BITS_PER_KEY >> segment)
    if n <= 1:
        return [rows]
    part = fresh("part", rows.columns)
    kept = cut(rows.withColumn(part, F.pmod(F.xxhash64(key, F.lit(5)), F.lit(n)).cast("int")), by=part)
    return [kept.where(F.col(part) == k).drop(part) for k in range(n)]


def _flag(maybe):
    @F.arrow_udf("boolean")
    def flag(key: pa.Array) -> pa.Array:
        return pa.array(maybe(key.to_numpy(zero_copy_only=False)))

    return flag


def _marked(seen: DataFrame, total: int, segment: int) -> DataFrame:
    """``seen`` with maybe: whether the key may be repeated."""
    parts = _in_segments(seen, total, segment)
    out = []
    for p in parts:
        maybe = lookup(seen.sparkSession, repeated_filter(p, total // len(parts), segment))
        marked = p.withColumn("maybe", _flag(maybe)("key"))
        out.append(marked if len(parts) == 1 else cut(marked))
        if len(parts) > 1:
            maybe.forget()
    return functools.reduce(DataFrame.union, out)


def _keepers(flagged: DataFrame) -> DataFrame:
    best = F.max(F.struct(F.col("chars"), (-F.col("doc_id")).alias("neg"))).alias("best")
    return flagged.groupBy("text_sha256").agg(F.count("*").alias("group_size"), best).select("text_sha256", "group_size", (-F.col("best.neg")).alias("keep_id"))


def decisions(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", segment: int = SEGMENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    seen = cut(digests(docs, text, doc_id))
    total = seen.count()
    marked = _marked(seen, total, segment)
    flagged = cut(marked.where("maybe").select("doc_id", "text_sha256", "chars"))
    keep = cut(_keepers(flagged))
    straight = marked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    big = F.col("group_size") > max(1000, total // HOT)  # fewer than HOT groups, so their keepers may be broadcast
    hot, few = F.broadcast(keep.where(big)), keep.where(~big)
    mine = flagged.join(hot, "text_sha256")
    others = flagged.join(hot.select("text_sha256"), "text_sha256", "left_anti").join(few, "text_sha256")
    compared = mine.unionByName(others).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return straight.union(compared)


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", segment: int = SEGMENT) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged; rows that are unique for certain are not shuffled."""
    sha, key, yes = (fresh(x, docs.columns) for x in ("text_sha256", "key", "maybe_repeated"))
    k_sha, k_id = fresh("k_sha", docs.columns), fresh("k_id", docs.columns)
    rows = docs.withColumn(sha, sha256(F.col(text))).withColumn(key, F.xxhash64(sha))
    total = docs.count()
    parts = _in_segments(rows, total, segment, key)
    out = []
    for p in parts:
        maybe = lookup(docs.sparkSession, repeated_filter(p.select(F.col(key).alias("key")), total // len(parts), segment))
        marked = p.withColumn(yes, _flag(maybe)(key))
        rest = marked.where(yes)
        flagged = rest.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(sha).alias("text_sha256"), F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long").alias("chars"))
        keep = cut(_keepers(flagged).select(F.col("text_sha256").alias(k_sha), F.col("keep_id").alias(k_id)))
        # by digest and doc_id, so the rows of a hot text are spread
        kept = rest.join(keep, (F.col(sha) == F.col(k_sha)) & F.col(doc_id).cast("long").eqNullSafe(F.col(k_id)), "left_semi").dropDuplicates([sha])
        stay = marked.where(~F.col(yes)).select(*docs.columns).union(kept.select(*docs.columns))
        out.append(stay if len(parts) == 1 else cut(stay))
        if len(parts) > 1:
            maybe.forget()
    return functools.reduce(DataFrame.union, out)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
             k AS (SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN k USING (text_sha256)"""
}
