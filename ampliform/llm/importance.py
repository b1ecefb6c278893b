"""Importance resampling towards a target: documents whose words are likelier in the target than in the corpus come first.

An untrained Split of the tokenizers library cuts each text, A-Z lower-cased, into words with their offsets. Windows of ``low`` to
``high`` offset pairs are the features: their words, joined by one space. A feature's bucket is the CRC of its bytes. The corpus
and the target are counted by bucket, whole; a bucket's gain compares both, and a document's weight is the sum of its features'
gains. A draw without replacement is the top of weight plus a Gumbel number that the document's id decides.

Texts are cut once: what is kept of a document is its buckets with their counts, at most ``buckets`` pairs whatever its length.
Counts are summed in each task before they are exchanged, so ``buckets`` rows a task are what meets, and the gains that go along
to all tasks are ``buckets`` numbers. The draw's ranks come from one exchange by ranges of the order, and the counts of its parts.

Edge cases: a null or empty text has no features, weight 0, and isn't drawn unless ``least`` is 0. Rows are documents by themselves,
so repeated rows have equal weights and scores, and ranks of their own. A null doc_id is hashed as an empty one and comes last
among equals. Without any target text, or without documents, the counts are 0 and the gains follow. Other columns are left
alone, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, cut, discard, fresh, pieces, utf8

#: What the words of a feature are made of.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of a text that are cut at a time, and words whose buckets are remembered.
PIECE, KNOWN = 1 << 17, 200_000

_SOLID = np.array([c >= 0x80 or chr(c).isdigit() or 97 <= c <= 122 for c in range(256)])


def _slices(text: bytes) -> Iterator[str]:
    """The lower-cased text in pieces that end where no word goes on."""
    text = text.translate(_LOWER)
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text):
            free = np.flatnonzero(~_SOLID[np.frombuffer(text, np.uint8, min(PIECE, len(text) - end), end)])
            if len(free):
                end += int(free[0])
                break
            end += PIECE
        yield text[at:end].decode()
        at = end


class _Buckets(dict):
    """Features and their buckets; it's emptied when it's full."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        b = self[feature] = zlib.crc32(feature.encode()) % self.buckets
        return b


def document_buckets(texts: list[bytes], low: int, high: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(words, features, buckets, counts) of each text."""
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
    bucket = _Buckets(buckets)
    for text in texts:
        words, total, held = 0, np.zeros(0, np.int64), []
        for piece in _slices(text):
            found = split.pre_tokenize_str(piece)
            names = held + [piece[a:b] for _, (a, b) in found]
            words += len(found)
            seen: list[int] = []
            for n in range(low, high + 1):
                # windows that end among the new words
                ends = range(max(n, len(held) + 1), len(names) + 1)
                seen += [bucket[w] for w in names[len(held) :]] if n == 1 else [bucket[" ".join(names[e - n : e])] for e in ends]
            held = names[len(names) - high + 1 :] if high > 1 else []
            if seen:
                total = np.bincount(np.array(seen), minlength=max(len(total), 1)) + (np.pad(total, (0, max(0, max(seen) + 1 - len(total)))))
        on = np.flatnonzero(total)
        yield words, int(total.sum()), on.astype(np.uint32), total[on]


def bucketed(rows: DataFrame, low: int, high: int, buckets: int) -> DataFrame:
    """(doc_id, th, n_words, n_features, at, n) of rows (doc_id, th, t): the buckets of a text and their counts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = list(document_buckets(utf8(b.column(2)), low, high, buckets))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2].astype("<u4").tobytes() for f in found], pa.binary()), pa.array([f[3].astype("<u4" if f[1] < 1 << 32 else "<u8").tobytes() for f in found], pa.binary())],
                names=["doc_id", "th", "n_words", "n_features", "at", "n"],
            )

    return rows.mapInArrow(run, "doc_id long, th long, n_words long, n_features long, at binary, n binary")


def _pairs(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at, n in zip(b.column("at"), b.column("n"), strict=True):
        x, y = at.as_py(), n.as_py()
        yield np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4" if len(x) == len(y) else "<u8").astype(np.int64)


def histogram(found: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket: each task sums its own rows, so what is exchanged and collected is ``buckets`` numbers a task, then in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for at, n in _pairs(b):
                total[at] += n
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(total[on])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("at", "n").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log of how much likelier a bucket is in the target, floored; one is added to each count."""
    s, t, k = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, th, n_words, n_features, weight) of what ``bucketed`` gives."""
    shared = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = [int((shared.value[at] * n).sum()) for at, n in _pairs(b)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(total, pa.int64())], names=["doc_id", "th", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id long, th long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousand times a Gumbel number, floored: the first 32 bits of a digest of seed and id decide it."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with rank, from 1 in the given order: they are dealt by ranges of it, and each part begins where the ones before it end."""
    part, place = fresh("part", rows.columns), fresh("place", rows.columns)
    dealt = rows.repartitionByRange(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).withColumn(part, F.spark_partition_id())
    kept = cut(dealt)  # the ranges come from a sample: what is counted must be what is ranked
    before = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy(part).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")  # one row a part
    within = kept.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return within.join(F.broadcast(sizes), part).withColumn("rank", (F.col(place) + F.col("before")).cast("long")).drop(part, place, "before")


def _rows(rows: DataFrame, text: str, doc_id: Column) -> DataFrame:
    t = F.col(text).cast("string")
    return rows.select(doc_id.cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t"))


def _scored(docs: DataFrame, target: DataFrame, low: int, high: int, buckets: int, percent: int, least: int, seed: int, text: str, doc_id: str, target_text: str) -> DataFrame:
    """doc_id, th (a hash of the text), n_features, weight, score and rank of each row."""
    found = cut(bucketed(_rows(docs, text, F.col(doc_id)), low, high, buckets))
    wanted = cut(bucketed(_rows(target, target_text, F.lit(None)), low, high, buckets))
    gain = gains(histogram(found, buckets), histogram(wanted, buckets))
    rows = cut(weights(found, gain).withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long")))
    discard(found, wanted)
    able = rows.where(F.col("n_words") >= least)
    draw = able.count() * percent // 100
    names = ("doc_id", "th", "n_features", "weight", "score")
    if not draw:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    # the bin of scores that the last one drawn lies in: what is below it needs no order
    bins = able.groupBy(F.floor(F.col("score") / 1024).alias("bin")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("bin")))
    floor = bins.withColumn("above", above).where(F.col("above") >= draw).agg(F.max("bin")).first()[0]
    reached = (F.col("n_words") >= least) & (F.floor(F.col("score") / 1024) >= floor)
    top = ranked(rows.where(reached).select(*names), [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("th")])
    return top.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).select(*names, "rank").union(rows.where(~reached).select(*names, F.lit(None).cast("long")))


def scored(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024, text: str = "text", doc_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row; rank is null unless the row is drawn: of those with ``least`` words,
    ``percent`` of a hundred, highest scores first, ties to the smaller doc_id."""
    return _scored(docs, target, low, high, buckets, percent, least, seed, text, doc_id, target_text).drop("th")


def resampled(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024, text: str = "text", doc_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """The drawn rows of ``docs``, columns unchanged. Of rows that agree in doc_id and text as many stay as were drawn."""
    drawn = _scored(docs, target, low, high, buckets, percent, least, seed, text, doc_id, target_text).where("rank is not null")
    i, h, n, own, place = (fresh(x, docs.columns) for x in ("r_id", "r_th", "r_n", "r_own", "r_place"))
    times = drawn.groupBy(F.col("doc_id").alias(i), F.col("th").alias(h)).agg(F.count("*").alias(n))
    both = docs.withColumn(own, F.xxhash64(F.col(text).cast("string"))).join(times, F.col(doc_id).cast("long").eqNullSafe(F.col(i)) & (F.col(own) == F.col(h)))
    return both.withColumn(place, F.row_number().over(Window.partitionBy(i, h).orderBy(F.lit(0)))).where(F.col(place) <= F.col(n)).select(*docs.columns)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_CRC = "(select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from (select unnest(range(256)) as i))"

ORACLE = {
    "op11_importance": f"""
      with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
      b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
      dw as (select doc_id, w, count(*) as n from (select doc_id, unnest(ws) as w from d) group by all),
      bw as (select w, count(*) as n from (select unnest(ws) as w from b) group by all),
      table_ as {_CRC},
      words as (select distinct w from (select w from dw union all select w from bw)),
      bytes as (select w, list_transform(range(0, octet_length(encode(w))), lambda i: cast('0x' || substr(hex(encode(w)), cast(2 * i + 1 as int), 2) as bigint)) as l from words),
      crc as (select w, xor(list_reduce(list_prepend(4294967295, l), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket from bytes, table_),
      s as (select bucket, sum(n) as s from dw join crc using (w) group by all),
      t as (select bucket, sum(n) as t from bw join crc using (w) group by all),
      gain as (select i as bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from t) + 10000)::double)))::bigint as g
               from (select unnest(range(10000)) as i) left join s on s.bucket = i left join t on t.bucket = i),
      w as (select doc_id, sum(n * g) as weight from dw join crc using (w) join gain using (bucket) group by all),
      sc as (select d.doc_id, len(ws)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
                    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score from d left join w using (doc_id)),
      r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from sc where n_features >= 20)
      select doc_id, n_features, weight, score, case when rank <= (select count(*) * 10 // 100 from r) then rank end as rank from sc left join r using (doc_id)""",
}
