"""Sharding: histogram sort. Law `bytes`: shards have near equal sizes.

Rows are ordered by (hash of the text, hash of the doc_id): equal texts stand together. The splitters between
shards are found by probing: each round counts exactly, in every partition, the bytes below a set of candidate boundaries
between the best bounds known so far, sums the counts, and narrows each splitter's bounds, until
its share is met within ``tolerance`` of a shard. A text whose copies are so many that no boundary between texts
meets the tolerance is split between its rows by the same rounds over the second hash. Then rows are exchanged once.

Each round moves ``probes`` numbers per splitter and partition and never rows. Places within a shard come from the row
counts of finer cells, whose size is bounded by the share of one hash value pair.

Edge cases: a null text has size 8 and the checksum of the empty text; rows equal in text and doc_id may be split, in
any order; an empty table gives an empty result; with fewer texts than shards some shards stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Candidate boundaries for each splitter and round; rounds at most for each of the two hashes (64 bits each).
PROBES, ROUNDS = 255, 10
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _below(rows: DataFrame, column: str, probes: np.ndarray) -> tuple[np.ndarray, int]:
    """(bytes of the rows below each probe, bytes of all rows), counted in each partition and summed."""
    shared = rows.sparkSession.sparkContext.broadcast(probes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(shared.value) + 1, np.int64)
        for pdf in batches:
            at = np.searchsorted(shared.value, pdf[column].to_numpy(np.int64), side="right")
            total += np.bincount(at, weights=pdf["size"].to_numpy(np.float64), minlength=len(total)).astype(np.int64)
        on = np.flatnonzero(total)
        yield pd.DataFrame({"cell": on, "n": total[on]})

    got = rows.select(column, "size").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(len(probes) + 1, np.int64)
    cells[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    below = np.cumsum(cells)
    return below[:-1], int(below[-1])


def _search(rows: DataFrame, column: str, goals: list[float], tolerance: float) -> list[tuple[int, int, int]]:
    """For each goal (bytes below it) the boundary and (boundary, bytes below it, bytes below the next hash value).

    Bounds close in until the nearer one is within tolerance or they are neighbours.
    """
    low = {g: (_LOW, 0) for g in goals}
    high: dict[float, tuple[int, int]] = {}
    done: dict[float, tuple[int, int, int]] = {}
    for _ in range(ROUNDS):
        open_ = [g for g in goals if g not in done]
        if not open_:
            break
        probes = []
        for g in open_:
            a, b = low[g][0], high[g][0] if g in high else _HIGH
            probes += [a + (b - a) * (k + 1) // (PROBES + 1) for k in range(PROBES)]
        probes = np.unique(np.array(probes, np.int64))
        below, total = _below(rows, column, probes)
        for g in open_:
            under = np.flatnonzero(below <= g)
            over = np.flatnonzero(below > g)
            if len(under) and int(probes[under[-1]]) > low[g][0]:
                low[g] = int(probes[under[-1]]), int(below[under[-1]])
            if len(over) and (g not in high or int(probes[over[0]]) < high[g][0]):
                high[g] = int(probes[over[0]]), int(below[over[0]])
            a, b = low[g], high.get(g, (_HIGH, total))
            if min(g - a[1], b[1] - g) <= tolerance or b[0] - a[0] <= 1:
                done[g] = (*a, a[1]) if g - a[1] <= b[1] - g else (*b, b[1])
                if min(g - a[1], b[1] - g) > tolerance:
                    done[g] = (*a, b[1])  # one hash value holds the goal: [a, b) is that value
    for g in goals:
        done.setdefault(g, (*low[g], low[g][1]))
    return [done[g] for g in goals]


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.02) -> list[tuple[int, int]]:
    """The first (text hash, row hash) of shards 1, 2, ... of rows (h, g, size)."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    goals = [total * (k + 1) / shards for k in range(shards - 1)]
    out: list[tuple[int, int]] = []
    inner: dict[int, list[tuple[int, float]]] = {}
    for k, (h, below, upto) in enumerate(_search(rows, "h", goals, tolerance * total / shards)):
        out.append((h, _LOW))
        if upto > below:
            inner.setdefault(h, []).append((k, goals[k] - below))
    several = {r.h for r in rows.where(F.col("h").isin(list(inner))).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").collect()} if inner else set()
    for h, wanted in inner.items():
        if h not in several:  # a single row can't be split
            continue
        found = _search(rows.where(F.col("h") == h), "g", [w for _, w in wanted], tolerance * total / shards)
        for (k, _), (g, _, _) in zip(wanted, found, strict=True):
            out[k] = (h, g)
    return sorted(out)


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.02, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = (F.octet_length(F.col(text).cast("string")).cast("long"))
    rows = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.coalesce(size, F.lit(0)) + 8).alias("size"), F.crc32(F.encode(t, "utf-8")).alias("text_crc32"), F.xxhash64(t).alias("h"), F.xxhash64(F.col(doc_id).cast("long"), F.lit(3)).alias("g")))
    edges = rows.sparkSession.sparkContext.broadcast(splitters(rows, shards, tolerance))
    # cells: enough that each holds few rows; a hot text's rows are dealt by the second hash
    cells = max(8 * shards, rows.count() // 2000)

    @F.pandas_udf("shard int, cell long")
    def place(h: pd.Series, g: pd.Series) -> pd.DataFrame:
        first = np.array([e[0] for e in edges.value], np.int64)
        h, g = h.to_numpy(np.int64), g.to_numpy(np.int64)
        at = np.searchsorted(first, h, side="left")
        for k, (eh, eg) in enumerate(edges.value):
            at = np.where((h == eh) & (g >= eg), np.maximum(at, k + 1), at)
        return pd.DataFrame({"shard": at.astype(np.int32), "cell": _cell(h, cells)})

    placed = rows.withColumn("p", place("h", "g")).select("*", "p.shard", "p.cell").drop("p")
    # rows of a shard are numbered cell by cell: cells in order, then the second hash's top bits
    placed = placed.withColumn("part", F.shiftright("g", 58))
    counts = placed.groupBy("shard", "cell", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).drop("n")
    within = F.row_number().over(Window.partitionBy("shard", "cell", "part").orderBy("h", "g", "doc_id")) - 1
    out = placed.withColumn("within", within).join(counts, ["shard", "cell", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("within") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    return ((h.astype(np.float64) - _LOW) / 2.0**64 * cells).astype(np.int64)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
