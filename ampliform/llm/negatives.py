"""Hard negatives: rows of other labels that score high against an anchor, but clearly below its positives.

The search is LEMP's: rows are dealt by length, and blocks of rows of like length hold a sorted list for each coordinate of the
normalised vectors. A query with a threshold has, for each of its ``FOCUS`` largest coordinates, a range of values outside of which no
row of the block can reach the threshold; rows within all ranges are candidates and are scored exactly. Where the narrowest
range still spans most of a block, the block is scored as one product of matrices: the same rows, exactly.

Anchors are the stated set of queries. They go along in waves of at most ``WAVE`` rows and ``WAVE_CELLS`` components, so what is broadcast is bounded, and a wave
passes over the blocks twice: once for the positives, then, with the window that each positive opens, for the negatives. Each query
begins with the threshold that it has among ``SEED`` rows, the smallest by hash. They are rows of the table, so it's a lower bound
and no result is lost. Each task keeps ``k`` rows a query and raises the threshold as it goes.

Edge cases: rows with a null label, a null vector, a null or non-finite component, or a component whose ``SCALE``-fold isn't within
2**24 take no part, so scores are exact longs. A shorter vector counts as filled up with zeros, an empty one as zeros. Rows that
agree in vec_id, label and vector are one; rows that share a vec_id otherwise are rows of their own, and each is an anchor. An
anchor without positives, or a positive without negatives in its window, gives no rows; so does an empty table. Ties go by vec_id,
then by a hash of the row. A null vec_id is no anchor and comes last among equals. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard

#: Components become whole numbers of this fraction.
SCALE = 256
#: Rows of a block, anchors of a wave, rows that thresholds begin with, coordinates that are looked up, cells of one numpy step.
BLOCK, WAVE, SEED, FOCUS, CELLS = 4096, 32_768, 2048, 4, 1 << 20
#: Components of a block's and of a wave's vectors together; long vectors make them shorter.
BLOCK_CELLS, WAVE_CELLS = 1 << 19, 1 << 22
#: Rows of a block are at least this share of its longest.
ALIKE = 0.9
#: Of a block, what the narrowest range may span for its rows to be looked at one by one.
NARROW = 0.25

_BLOCK = "dim int, n int, vectors binary, ids binary, rids binary, labels binary, longest double, shortest double, orders binary"
_FOUND = "query long, rid long, vec_id long, score long"
_LAST = np.iinfo(np.int64).max


def prepared(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v, dim, length, rid): whole-number vectors, their length, and a hash of the row, for rows that take part."""
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull())
    fits = F.forall("x", lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < (1 << 24) / SCALE), F.lit(False)))
    v = F.transform("x", lambda c: F.floor(c * SCALE).cast("int"))
    rows = rows.where(fits).select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), v.alias("v"))
    rows = rows.distinct()
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))
    return rows.withColumn("dim", F.size("v")).withColumn("length", length).withColumn("rid", F.xxhash64("vec_id", "label", "v"))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.float64)
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Block:
    """Rows of like length, by vec_id, with the order of each coordinate of their normalised vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rids: np.ndarray, labels: np.ndarray, longest: float, shortest: float, orders: np.ndarray | None = None):
        self.vectors, self.ids, self.rids, self.labels, self.longest, self.shortest = vectors, ids, rids, labels, longest, shortest
        length = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = vectors / np.where(length > 0, length, 1)[:, None]
        self.orders = np.argsort(self.unit, axis=0, kind="stable").astype(np.uint16) if orders is None else orders
        self.sorted = np.take_along_axis(self.unit, self.orders.astype(np.int64), axis=0)


def blocks(rows: DataFrame, parts: int) -> DataFrame:
    """The rows dealt by ranges of length, longest first, and packed: a part is never held, only the block that is being filled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            dims = b.column("dim").to_numpy()
            dim = max(1, int(dims.max(initial=1)))
            v, n = _vectors(b.column("v"), dim), b.column("length").to_numpy()
            ids = b.column("vec_id").fill_null(_LAST).to_numpy()
            for row in zip(v.astype(np.int32), ids, b.column("rid").to_numpy(), b.column("label").to_numpy(), n, strict=True):
                if held and (len(held) >= min(BLOCK, max(1, BLOCK_CELLS // dim)) or len(held[0][0]) != dim or row[4] < ALIKE * held[0][4]):
                    yield flushed(held)
                    held = []
                held.append(row)
        if held:
            yield flushed(held)

    def flushed(held: list[tuple]) -> pa.RecordBatch:
        held = sorted(held, key=lambda r: (r[1], r[2]))
        v = np.stack([r[0] for r in held])
        ids, rids, labels = (np.array([r[i] for r in held], np.int64) for i in (1, 2, 3))
        lengths = [r[4] for r in held]
        block = Block(v.astype(np.float64), ids, rids, labels, max(lengths), min(lengths))
        values = [v.shape[1], len(v), v.astype("<i4").tobytes(), ids.tobytes(), rids.tobytes(), labels.tobytes(), block.longest, block.shortest, block.orders.astype("<u2").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in values], names=[c.split()[0] for c in _BLOCK.split(", ")]).cast(_SCHEMA)

    order = [F.desc("length"), F.asc("rid")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions("dim", *order)
    return dealt.select("vec_id", "label", "v", "dim", "length", "rid").mapInArrow(pack, _BLOCK)


_SCHEMA = pa.schema([("dim", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("vectors", "ids", "rids", "labels")), ("longest", pa.float64()), ("shortest", pa.float64()), ("orders", pa.binary())])


def _opened(b: pa.RecordBatch) -> Iterator[Block]:
    for i in range(b.num_rows):
        x = {c: b.column(c)[i].as_py() for c in b.schema.names}
        long = lambda c: np.frombuffer(x[c], np.int64)  # noqa: B023, E731
        v = np.frombuffer(x["vectors"], "<i4").reshape(x["n"], x["dim"]).astype(np.float64)
        yield Block(v, long("ids"), long("rids"), long("labels"), x["longest"], x["shortest"], np.frombuffer(x["orders"], "<u2").reshape(x["n"], x["dim"]))


class Queries:
    """Anchors as matrix rows, and questions: of which anchor, with the same or another label, scores from ``low`` to ``high``, the first ``k``."""

    def __init__(self, vectors: np.ndarray, rids: np.ndarray, labels: np.ndarray, of: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int):
        self.vectors, self.rids, self.labels, self.of, self.same, self.low, self.high, self.k = vectors, rids, labels, of, same, low, high, k

    def part(self, some: np.ndarray) -> Queries:
        return Queries(self.vectors, self.rids, self.labels, self.of[some], self.same, self.low[some], self.high[some], self.k)


def feasible(q: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of one coordinate that a unit vector may have, if its angle to a unit vector with coordinate ``q`` there has this cosine at least."""
    a, b = np.arccos(np.clip(q, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return np.cos(np.minimum(np.pi, a + b)) - 1e-9, np.cos(np.maximum(0, a - b)) + 1e-9


class State:
    """The best rows of each question so far, and the threshold that they set."""

    def __init__(self, q: Queries, floor: np.ndarray):
        self.q, self.floor = q, floor.copy()
        self.rows = np.empty((0, 4), np.int64)  # question, -score, vec_id, rid
        self.looked = self.scored = 0

    def offer(self, question: np.ndarray, score: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        if not len(question):
            return
        new = np.stack([question, -score.astype(np.int64), ids, rids], axis=1)
        rows = np.concatenate([self.rows[np.isin(self.rows[:, 0], question)], new])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        start = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        place = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
        last = rows[place == self.q.k - 1]
        self.floor[last[:, 0]] = np.maximum(self.floor[last[:, 0]], -last[:, 1])
        self.rows = np.concatenate([self.rows[~np.isin(self.rows[:, 0], question)], rows[place < self.q.k]])

    def look(self, block: Block) -> None:
        """All rows of a block that may be among the first ``k`` of a question."""
        q, n = self.q, len(block.ids)
        dim = min(q.vectors.shape[1], block.vectors.shape[1])
        own = q.vectors[:, :dim]
        length = np.sqrt((q.vectors * q.vectors).sum(axis=1))
        # one threshold an anchor: the lowest of its questions
        least = np.full(len(own), np.inf)
        np.minimum.at(least, q.of, self.floor)
        live = np.isfinite(least) | (least < 0)
        edge = np.where(least > 0, block.longest, block.shortest) * length
        cosine = np.where(edge > 0, least / np.where(edge > 0, edge, 1), np.where(least > 0, 2.0, -1.0))
        live &= cosine <= 1 + 1e-9
        anchors = np.flatnonzero(live)
        if not len(anchors):
            return
        unit = own[anchors] / np.where(length[anchors] > 0, length[anchors], 1)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        first, last, low, high = (np.zeros(focus.shape, t) for t in (np.int64, np.int64, np.float64, np.float64))
        for f in np.unique(focus):
            at = np.nonzero(focus == f)
            low[at], high[at] = feasible(unit[at[0], f], cosine[anchors][at[0]])
            first[at], last[at] = np.searchsorted(block.sorted[:, f], low[at]), np.searchsorted(block.sorted[:, f], high[at], side="right")
        span = last - first
        narrowest = span.argmin(axis=1)
        width = span[np.arange(len(anchors)), narrowest]
        by_anchor = np.argsort(q.of, kind="stable")
        begin = np.searchsorted(q.of[by_anchor], np.arange(len(own) + 1))
        self.looked += n * len(anchors)
        for i in np.flatnonzero((width > 0) & (width <= NARROW * n)):
            f = focus[i, narrowest[i]]
            rows = block.orders[first[i, narrowest[i]] : last[i, narrowest[i]], f].astype(np.int64)
            values = block.unit[rows][:, focus[i]]
            rows = np.sort(rows[((values >= low[i]) & (values <= high[i])).all(axis=1)])
            self.scored += len(rows)
            a = anchors[i]
            self._ask(by_anchor[begin[a] : begin[a + 1]], (block.vectors[rows, :dim] @ own[a])[None], np.zeros(begin[a + 1] - begin[a], int), block, rows)
        wide = anchors[width > NARROW * n]
        every = np.arange(n)
        step = max(1, CELLS // n)
        for s in range(0, len(wide), step):
            some = wide[s : s + step]
            scores = own[some] @ block.vectors[:, :dim].T
            self.scored += scores.size
            asked = np.concatenate([by_anchor[begin[a] : begin[a + 1]] for a in some])
            place = np.repeat(np.arange(len(some)), [begin[a + 1] - begin[a] for a in some])
            for t in range(0, len(asked), step):
                self._ask(asked[t : t + step], scores, place[t : t + step], block, every)

    def _ask(self, asked: np.ndarray, scores: np.ndarray, place: np.ndarray, block: Block, rows: np.ndarray) -> None:
        q = self.q
        s = scores[place]
        alike = q.labels[q.of[asked]][:, None] == block.labels[rows][None]
        ok = (s >= np.maximum(self.floor[asked], q.low[asked])[:, None]) & (s <= q.high[asked][:, None]) & (alike == q.same)
        if q.same:
            ok &= q.rids[q.of[asked]][:, None] != block.rids[rows][None]
        # rows stand by vec_id: of equals the first k are enough, so a block of copies brings no more
        i, j = np.nonzero(ok)
        order = np.lexsort((j, -s[i, j], i))
        i, j = i[order], j[order]
        start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, int)
        place_of = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)])) if len(i) else np.empty(0, int)
        keep = place_of < q.k
        i, j = i[keep], j[keep]
        self.offer(asked[i], s[i, j], block.ids[rows[j]], block.rids[rows[j]])


def _floors(q: Queries, seed: Block | None) -> np.ndarray:
    """The k-th best score of each question among the seed rows; its window's low end if there are fewer."""
    state = State(q, q.low)
    if seed is not None:
        state.look(seed)
    return state.floor


def search(index: DataFrame, q: Queries, seed: Block | None) -> DataFrame:
    """(query, rid, vec_id, score): each task's first ``k`` rows of each question, none that cannot be among the first of all."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast((q, _floors(q, seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floor = shared.value
        state = State(q, floor)
        for b in batches:
            for block in _opened(b):
                state.look(block)
        r = state.rows
        r = r[-r[:, 1] >= state.floor[r[:, 0]]]
        for s in range(0, len(r), 65_536):
            x = r[s : s + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 3]), pa.array(x[:, 2]), pa.array(-x[:, 1])], names=["query", "rid", "vec_id", "score"])

    return index.mapInArrow(run, _FOUND)


def first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each question, with rank from 1."""
    r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "rid"))
    return found.withColumn("rank", r).where(F.col("rank") <= k)


def _taken(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, rids, labels and ids of a bounded number of rows."""
    t = rows.select("vec_id", "label", "v", "rid").orderBy("vec_id", "rid").toArrow().combine_chunks()
    if not t.num_rows:
        return np.zeros((0, dim)), *(np.empty(0, np.int64) for _ in range(3))
    v = t.column("v").combine_chunks()
    return _vectors(v, dim), *(t.column(c).combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rid", "label", "vec_id"))


def hard_negatives(embeddings: DataFrame, anchor: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a condition on vec_id; every hundredth
    if there's none) and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of another label whose score is
    from ``low`` to ``high`` hundredths of the positive's."""
    spark = embeddings.sparkSession
    rows = cut(prepared(embeddings, vec_id, vector, label))
    dim, n = rows.agg(F.max("dim"), F.count("*")).first()
    dim = max(1, dim or 1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (8 * BLOCK)))
    index = cut(blocks(rows, parts))
    asks = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    anchors = cut(rows.where(F.col("vec_id").isNotNull() & asks).select("vec_id", "label", "v", "rid"))
    v, rids, labels, ids = _taken(rows.orderBy(F.xxhash64("rid", F.lit(1)), "rid").limit(min(SEED, max(1, BLOCK_CELLS // dim))), dim)
    lengths = np.sqrt((v * v).sum(axis=1))
    by = np.lexsort((rids, ids))
    seed = Block(v[by], ids[by], rids[by], labels[by], float(lengths.max()), float(lengths.min())) if len(v) else None
    waves = 1
    while (anchors.groupBy(_wave(waves).alias("w")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > min(WAVE, max(1, WAVE_CELLS // dim)):
        waves *= 2
    out = [_one_wave(index, anchors.where(_wave(waves) == w), dim, seed, positives, negatives, low, high) for w in range(waves)]
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    discard(rows, anchors, index)  # waves are written already
    return result


def _wave(waves: int) -> Column:
    return F.pmod(F.xxhash64("rid", F.lit(2)), F.lit(waves))


def _one_wave(index: DataFrame, anchors: DataFrame, dim: int, seed: Block | None, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = index.sparkSession
    v, rids, labels, ids = _taken(anchors, dim)
    n = len(v)
    q = Queries(v, rids, labels, np.arange(n), True, np.full(n, -np.inf), np.full(n, np.inf), positives)
    found = first(search(index, q, seed), positives).select("query", "vec_id", "score", "rid").orderBy("query", F.desc("score"), "vec_id", "rid").toArrow()  # at most ``positives`` an anchor of the wave
    of, p_id, p = (found.column(c).to_numpy().astype(np.int64) for c in ("query", "vec_id", "score"))
    # 30 p <= 100 s <= 90 p in whole numbers
    least, most = -((-low * p) // 100), (high * p) // 100
    open_ = least <= most
    of, p_id, p, least, most = (x[open_] for x in (of, p_id, p, least, most))
    q = Queries(v, rids, labels, of, False, least.astype(float), most.astype(float), negatives)
    pairs = pa.table({"query": np.arange(len(of)), "anchor_id": ids[of] if len(of) else np.empty(0, np.int64), "positive_id": p_id, "positive_score": p})
    got = first(search(index, q, seed), negatives).select("query", "vec_id", "score", "rank")
    named = F.broadcast(spark.createDataFrame(pairs))
    null = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return cut(got.join(named, "query").select("anchor_id", null("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), null("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = {
    "op12_hard_negatives": """
      with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
                 from (select distinct vec_id, label, embedding from embeddings) where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
      s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
      p as (select anchor_id, vec_id as positive_id, score as positive_score from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same) where k <= 5),
      n as (select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
            from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
      select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10""",
}
