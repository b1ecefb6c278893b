"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, word pairs and pairs with one word between, hashed into 2**28
coordinates. The model is fitted on a bounded sample of labelled rows: those with the smallest hash of their doc_id, at
most ``SAMPLE`` rows and ``SAMPLE_BYTES`` bytes of whole texts. They are one FTRL-proximal sequence (per-coordinate rates,
L1) of ``PASSES`` passes, so one task runs it; the bounds hold what it keeps, and a lost task runs again to the same
result. Features that fewer than ``SEEN`` rows of the sample have are not coordinates. What is broadcast is the few
weights that L1 left. Every row is scored, whole text.

Edge cases: null and empty texts get the score of the bias alone; labels that are null are no examples; a doc_id
with several labels takes the largest; without any label, or with one class only, every score is the smoothed share
of toxic labels. Rows are scored one by one, so repeated rows agree and extra columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PUNCTUATION, batched_words, cut, fresh, mix, pieces, utf8

#: Rows and bytes of text that the model is fitted on at most; passes; rows that must have a feature.
SAMPLE, SAMPLE_BYTES, PASSES, SEEN = 10_000, 64 << 20, 10, 4
#: FTRL's rate, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.0
_BITS = 28


def features(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text of each feature, feature) for runs of texts; a feature may repeat within a text."""
    mask = np.uint64((1 << _BITS) - 1)
    for first, w, n in batched_words(texts, PUNCTUATION):
        doc = np.repeat(np.arange(len(n)), n)
        owner, parts = [doc], [w]
        for gap, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            same = doc[:-gap] == doc[gap:]
            owner.append(doc[:-gap][same])
            parts.append(mix(w[:-gap][same] * np.uint64(odd) + w[gap:][same]))
        yield first, np.concatenate(owner), (np.concatenate(parts) & mask).astype(np.uint32)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from fitting: crc32 of its doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _examples(docs: DataFrame, labels: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(y, feats) of the sampled labelled rows."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select(F.col("doc_id").alias("id"), "y"))
    t = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), t.alias("t"), F.xxhash64(t).alias("th"))
    first = (F.xxhash64("id"), F.col("id"), F.col("th"))
    # a doc_id may have many rows, so the bounds hold for rows again; ``SAMPLE`` rows are the window's at most
    some = rows.join(F.broadcast(known), "id").select("id", "th", "y", F.coalesce(F.octet_length("t"), F.lit(0)).alias("size")).distinct().orderBy(*first).limit(SAMPLE)
    some = some.withColumn("upto", F.sum("size").over(Window.orderBy(*first).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= SAMPLE_BYTES).select("id", "th", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = [b""] * b.num_rows
            for first, doc, f in features(utf8(b.column(1))):
                both = np.unique(doc.astype(np.uint64) << np.uint64(32) | f)
                at = np.searchsorted(both >> np.uint64(32), np.arange(int(doc[-1]) + 2 if len(doc) else 1))
                for i, (x, y) in enumerate(zip(at, at[1:], strict=False)):
                    out[first + i] = (both[x:y] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["y", "feats"])

    taken = rows.join(F.broadcast(cut(some)), ["id", "th"]).dropDuplicates(["id", "th"])
    return taken.select("y", "t").mapInArrow(run, "y int, feats binary")


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows: list[tuple[int, np.ndarray]], size: int, base: float) -> np.ndarray:
    """The weights after ``PASSES`` passes over rows (label, its coordinates below ``size``); the last one is the bias beyond base."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(PASSES):
        for y, at in rows:
            w = _weights(z[at], n[at])
            g = 1 / (1 + np.exp(-np.clip(w.sum() + base, -30, 30))) - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return _weights(z, n)


def _learn(base: float):
    """The pass over the sample's one partition, in an order drawn from the rows themselves."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((zlib.crc32(f), y, f) for b in batches for y, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        seen = [np.frombuffer(f, np.uint32) for _, _, f in held]
        names, count = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.empty(0, np.uint32), np.empty(0, int))
        names = names[count >= SEEN]
        rows = []
        for (_, y, _), f in zip(held, seen, strict=True):
            at = np.minimum(np.searchsorted(names, f), max(0, len(names) - 1))
            rows.append((y, np.append(at[names[at] == f] if len(names) else at[:0], len(names))))
        w = ftrl(rows, len(names), base)
        on = np.flatnonzero(w[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([-1, *names[on].tolist()], pa.int64()), pa.array([base + w[-1], *w[on].tolist()], pa.float64())], names=["f", "w"])

    return learn


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, features sorted, their weights)."""
    rows = cut(_examples(docs, labels, text, doc_id))
    seen, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    base = float(np.log((toxic + 0.5) / (seen - toxic + 0.5)))
    if toxic in (0, seen):
        return base, np.empty(0, np.uint32), np.empty(0, np.float32)
    got = rows.coalesce(1).mapInArrow(_learn(base), "f long, w double").toPandas().sort_values("f")
    return float(got["w"].iloc[0]), got["f"].to_numpy()[1:].astype(np.uint32), got["w"].to_numpy()[1:].astype(np.float32)


def scorer(spark: SparkSession, model: tuple[float, np.ndarray, np.ndarray]):
    """A function from texts (bytes) to scores."""
    shared = spark.sparkContext.broadcast(model)

    def score(texts: list[bytes]) -> np.ndarray:
        bias, names, w = shared.value
        total = np.full(len(texts), bias)
        gate = np.zeros(1 << 16, bool)
        gate[names & 0xFFFF] = True
        for first, doc, f in features(texts) if len(names) else ():
            may = gate[f & np.uint32(0xFFFF)]
            doc, f = doc[may], f[may]
            at = np.minimum(np.searchsorted(names, f), len(names) - 1)
            hit = names[at] == f
            both = np.unique(doc[hit] * len(names) + at[hit])
            np.add.at(total, first + both // len(names), w[both % len(names)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    return score


def scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    score = scorer(docs.sparkSession, fit(docs, labels, text, doc_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(utf8(b.column(1))))], names=["doc_id", "score"])

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, columns unchanged."""
    score = scorer(docs.sparkSession, fit(docs, labels, text, doc_id))

    @F.arrow_udf("double")
    def look(t: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([score(utf8(t.slice(i, 512))) for i in range(0, len(t), 512)] or [np.empty(0)]))

    name = fresh("toxicity", docs.columns)
    return docs.withColumn(name, look(F.col(text).cast("string"))).where(F.col(name) < 0.5).drop(name)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
