"""Token counts: a finite-state tokenizer whose transitions carry emitted-token counts.

The vocabulary (a sentencepiece BPE model) is compiled, state by state as states are met, into a deterministic
transducer over characters, in a table that is emptied when it's full. A state is the set of suffixes that a later token
may begin with, each with the token before it; a transition adds the tokens that the longer prefix has more than the
shorter (it may be negative: a later character can join tokens). No merge goes over the edge of a unit (blanks with the
letters after them, or another character), so the transducer starts anew there.

A text longer than ``LONG`` characters is cut into chunks, which are rows of their own. Each chunk's state map says what it
does to any state that comes in: up to its first edge the state matters, from there on the count and the last state
are known. A chunk without an edge keeps where the start state leads, and a place early on by which other states
have mostly come together with it; only if one hasn't, the chunk is walked again. Maps compose associatively, two
neighbours at a time, level by level over the whole table: a parallel prefix scan in as many exchanges as the longest
text's chunks have binary digits.

Edge cases: null and empty texts have no token; a character that the vocabulary lacks counts one token for each
of its UTF-8 bytes; U+2581 counts as a blank, as the library has it; control tokens' strings in a text are plain
text. Each row is counted by itself, so repeated rows and extra columns need no care; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pieces, utf8
from .pairwise import NEVER, Machine, State

#: Characters of a text that is counted in one go at most, characters of a chunk, characters after which states are compared,
#: units memoised and states kept at most.
LONG, CHUNK, MEET, MEMO, STATES = 1 << 20, 1 << 18, 4096, 400_000, 150_000


class Map(NamedTuple):
    """What a stretch of text does to a state. head: its text up to the first edge, or all of it; edge: whether it has one; last:
    its last character; total and end: tokens and entries after the head, or without an edge those that the start state
    gives; met: tokens and entries after the first ``MEET`` characters then."""

    head: str
    edge: bool
    last: str
    total: int
    end: tuple
    met: tuple | None


class Counter(Machine):
    """The transducer of one model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [(model.id_to_piece(i), i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        score = {p.replace("▁", " "): -model.get_score(i) for p, i in names}
        joined = sorted({c for p in score if len(p) > 1 for c in p} - {" "})
        if any(" " in p.lstrip(" ") for p in score):
            raise ValueError("a token of this vocabulary spans words")
        letters = "".join(re.escape(c) for c in joined)
        self.units = re.compile(f" *[{letters}]+| +|[^ {letters}]")
        #: The first place where a unit begins after another.
        self.edge = re.compile(f"(?<=[^ ]) |(?<=[^ {letters}])[{letters}]|(?<=.)[^ {letters}]", re.DOTALL)
        cost = lambda piece: 1 if piece in score else len(piece.encode())
        # the weight of an encoding: its tokens beyond those of the whole text so far
        settle = lambda weights: (weights[0], [w - weights[0] for w in weights])
        super().__init__(set(score), lambda a, b: score.get(a + b, NEVER), 0, lambda w, p: w + cost(p), settle, STATES)
        self.memo = _Memo(self)

    def walk(self, state: State, text: str) -> tuple[int, State]:
        """The tokens that a stretch within one unit adds, and the state after it."""
        total = 0
        for c in text:
            state, add = state[c]
            total += add
        return total, state

    def closed(self, text: str) -> int:
        """The tokens of a text that begins and ends at a unit's edge."""
        return sum(map(self.memo.__getitem__, self.units.findall(text)))

    def map(self, text: str) -> Map:
        """The state map of a chunk."""
        if first := self.edge.search(text):
            at = first.start()
            *whole, tail = self.units.findall(text, at)
            total, end = self.walk(self.start, tail)
            return Map(text[:at], True, text[-1], total + sum(map(self.memo.__getitem__, whole)), end.entries, None)
        met, state = self.walk(self.start, text[:MEET])
        entries = state.entries
        total, end = self.walk(state, text[MEET:])
        return Map(text, False, text[-1], met + total, end.entries, (met, entries))

    def enter(self, entries: tuple, m: Map) -> tuple[int, tuple]:
        """The tokens of a map's head, and the entries after it, if these come in."""
        total, state = self.walk(self.state(entries), m.head[:MEET])
        if not m.edge and state.entries == m.met[1]:
            return total + m.total - m.met[0], m.end
        rest, state = self.walk(state, m.head[MEET:])
        return total + rest, state.entries

    def compose(self, a: Map, b: Map) -> Map:
        """Two neighbours' maps as one."""
        edge = self.edge.search(a.last + b.head[:1]) is not None if b.head else True
        n, end = self.enter(self.start.entries if edge else a.end, b)
        n, end = (n + b.total, b.end) if b.edge else (n, end)
        if edge or a.edge:
            return Map(a.head, True, b.last, n + (a.total if a.edge else 0), end, None)
        if b.edge:  # no unit begins before the one in b
            return Map(a.head + b.head, True, b.last, b.total, b.end, None)
        head = a.head + b.head
        met = a.met
        if len(a.head) < MEET:
            met, state = self.walk(self.start, head[:MEET])
            met = (met, state.entries)
        return Map(head, False, b.last, a.total + n, end, met)

    def total(self, m: Map) -> int:
        """The tokens of a whole text from its map."""
        return m.total + (self.walk(self.start, m.head)[0] if m.edge else 0)

    def count(self, text: str) -> int:
        """The tokens of a text, with the blank that the model puts before it."""
        return self.closed(" " + text.replace("▁", " ")) if text else 0


class _Memo(dict):
    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, unit: str) -> int:
        n = self.counter.walk(self.counter.start, unit)[0]
        if len(unit) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[unit] = n
        return n


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One transducer for each model and Python worker."""
    return Counter(path)


def _long_counts(texts: DataFrame, path: str, most: int) -> DataFrame:
    """(th, n_tokens) of each distinct text of ``texts`` (th, t), none longer than ``most`` characters."""
    chunk = lambda i: F.substring(F.col("t"), i * CHUNK + 1, F.lit(CHUNK))
    last = F.floor((F.length("t") - 1) / CHUNK).cast("int")
    rows = texts.dropDuplicates(["th"]).select("th", F.posexplode(F.transform(F.sequence(F.lit(0), last), chunk)).alias("i", "chunk")).repartition("th", "i")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in pieces(batches, 16):
            maps = [c.map(" " * (i == 0) + t.decode().replace("▁", " ")) for i, t in zip(b.column(1).to_pylist(), utf8(b.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(pickle.dumps, maps), pa.binary())], names=["th", "i", "map"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        """The one or two maps of a pair."""
        c, pdf = counter(path), pdf.sort_values("i")
        m = functools.reduce(c.compose, map(pickle.loads, pdf["map"]))
        return pd.DataFrame({"th": pdf["th"].iloc[:1], "i": pdf["i"].iloc[:1] // 2, "map": [pickle.dumps(m)]})

    maps = rows.mapInArrow(start, "th long, i int, map binary")
    for _ in range(((most - 1) // CHUNK).bit_length()):
        maps = maps.groupBy("th", (F.col("i") / 2).cast("int").alias("pair")).applyInPandas(join, "th long, i int, map binary")

    @F.arrow_udf("long")
    def total(m: pa.Array) -> pa.Array:
        return pa.array([counter(path).total(pickle.loads(x)) for x in m.to_pylist()], pa.int64())

    return maps.select("th", total("map").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, limit: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in pieces(batches):
            texts = utf8(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array((c.count(t.decode()) for t in texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    t = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("t"))
    long = F.coalesce(F.length("t"), F.lit(0)) > LONG
    out = rows.where(~long).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    if most := rows.where(long).agg(F.max(F.length("t"))).first()[0]:
        some = rows.where(long).withColumn("th", F.xxhash64("t"))
        counts = cut(_long_counts(some.select("th", "t"), path, most))
        out = out.union(some.select("doc_id", "th", F.octet_length("t").cast("long").alias("n_bytes")).join(counts, "th").select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
