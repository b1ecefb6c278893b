"""N-gram Jaccard join: a token-group matrix over five-word shingles.

Sets are the distinct shingles of a text; equal sets are one class. Groups of similar sets are formed first, by
verified links to the first set that shares a rare shingle. The matrix stores each group's token union, first as a
bitmap. A set is a query to every other group that shares one of its *prefix* tokens (two sets that link share a
token among the rarest quarter of each, whatever fixed order the tokens have); the bound |query and union| >= 0.75
|query| decides whether the group is opened, on the bitmap before any text moves and on the tokens after, and only
opened groups compare members. A query needs one link into a group, as the group is connected already, so groups of
copies cost no pairs.

The order is by a count sketch of all documents' tokens (``CELLS`` counters, up to eight times as many by the number of rows, so a counter
stands for about as many tokens at any size up to there), then by hash: tokens of common passages come last, and lists of a token stay short. Tokens travel packed in arrays, and only repeated ones leave
the first exchange; a token that very many sets have is salted by set there. Groups are dealt in chunks of
``MEMBERS`` sets, each with its own union. Near copies of one text that lie just too far apart have no group: the sets without
one that share a token meet block by block, and only pairs that may link become rows; looking at them still grows with
the square of their number. A set's bitmap has two to four bits a token: each bit that one set has and another lacks
is a token that the other lacks, so the bitmaps' bound never rules a link out.

Edge cases: a null text, or one without words, has the empty set and links with nothing; a text of one to four words is
one shingle; equal texts are one class whatever their number; rows repeating a doc_id are alike; a null doc_id
never names a component unless all of its members' are null; extra columns are left alone.
"""

from __future__ import annotations

import math
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched_words, connected_components, cut, discard, fresh, give_back, group_rows, mix, pieces, utf8
from .exact_dedup import lookup, repeated_filter

#: Words of a shingle, the similarity in hundredths, counters of the sketch at least, sets of a chunk of a group.
WORDS, SIMILAR, CELLS, MEMBERS = 5, 75, 1 << 21, 512
_SEGMENT = 1 << 16
#: The class of count from which a token is salted by its sets; it passes as repeated without a count.
_HOT = 17
#: A token that more than LONG sets without a group have; their pairs are looked at in cells of two blocks of about BLOCK of them.
LONG, BLOCK = 16, 256


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(text, its distinct shingle hashes, sorted) of each text that has words."""
    k = np.uint64(0x9E3779B97F4A7C15)
    for first, w, n in batched_words(texts):
        ends = np.cumsum(n)
        if len(w) >= words:
            h = w[: len(w) - words + 1].copy()
            for j in range(1, words):
                h = h * k + w[j : len(w) - words + 1 + j]
            h = mix(h)
        for i, (e, m) in enumerate(zip(ends, n, strict=True)):
            if m >= words:
                yield first + i, np.unique(h[e - m : e - words + 1])
            elif m:
                one = np.full(1, m, np.uint64)
                for x in w[e - m : e]:
                    one = one * k + x
                yield first + i, mix(one)


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix(np.array([np.sum(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64) + np.uint64(len(tokens))])).view(np.int64)[0])


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each token, the last bits of its hash naming it; as many bits as the power of two from twice the tokens on."""
    bits = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    on = np.zeros(bits, np.uint8)
    on[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(on, bitorder="little").tobytes()


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap in fewer bytes."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0) if len(bits) > size else bits


def _lacking(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound on the tokens of a that b lacks, from their bitmaps."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(_fold(a, size) & ~_fold(b, size)).sum())


def _may_overlap(n: int, a: bytes, m: int, b: bytes, similar: int) -> bool:
    """Whether sets of n and m tokens can link by their bitmaps."""
    if 100 * min(n, m) < similar * max(n, m):
        return False
    need = -(-similar * (n + m) // (100 + similar))  # tokens in common
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    return _lacking(x, y) <= n - need and _lacking(y, x) <= m - need


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    t = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("t"), F.xxhash64(t).alias("th"))


def _cells(rows: int) -> int:
    """Counters of the sketch for so many documents: eight each, a power of two from ``CELLS`` to 8 * ``CELLS`` (a byte each once merged)."""
    return min(8 * CELLS, max(CELLS, 1 << (8 * max(1, rows) - 1).bit_length()))


def _cell(tokens: np.ndarray, cells: int) -> np.ndarray:
    """The counter of each token: the first bits of its hash."""
    return (tokens >> np.uint64(65 - cells.bit_length())).view(np.int64)


def _classes_and_sketch(texts: DataFrame, cells: int) -> DataFrame:
    """Rows of two kinds: (doc_id, th, n, set_id, bits) of each document, the bitmap with the first of a partition's equal sets,
    and (seg, at, count) pieces of the token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        names = ["doc_id", "th", "n", "set_id", "bits", "seg", "at", "count"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        seen: set[int] = set()
        for b in pieces(batches, 512):
            n, ids, bits = [0] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
            for i, s in shingle_sets(utf8(b.column(1))):
                n[i], ids[i] = len(s), set_id(s)
                if ids[i] not in seen:
                    seen.add(ids[i])
                    bits[i] = bitmap(s)
                np.add.at(total, _cell(s, cells), np.uint32(1))
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, kinds[2]), pa.array(ids, kinds[3]), pa.array(bits, kinds[4]), *(none.cast(k) for k in kinds[5:])], names=names)
        out = []
        for seg in range(cells // _SEGMENT):
            part = total[seg * _SEGMENT : (seg + 1) * _SEGMENT]
            at = np.flatnonzero(part)
            if len(at):
                gaps = np.diff(at, prepend=0).astype(np.uint16)
                out.append((seg, zlib.compress(gaps.tobytes(), 1), zlib.compress(part[at].astype(np.int32).tobytes(), 1)))
        none = pa.nulls(len(out))
        del total, seen
        give_back()
        yield pa.RecordBatch.from_arrays([*(none.cast(k) for k in kinds[:5]), *(pa.array([o[j] for o in out], kinds[5 + j]) for j in range(3))], names=names)

    return texts.mapInArrow(run, "doc_id long, th long, n long, set_id long, bits binary, seg int, at binary, count binary")


def _order(pieces: DataFrame, cells: int) -> np.ndarray:
    """The class (the logarithm of the count) of each cell of the sketch."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_SEGMENT, np.int64)
        for gaps, count in zip(pdf["at"], pdf["count"], strict=True):
            total[np.cumsum(np.frombuffer(zlib.decompress(gaps), np.uint16), dtype=np.int64)] += np.frombuffer(zlib.decompress(count), np.int32)
        return pd.DataFrame({"seg": pdf["seg"].iloc[:1], "cls": [np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8).tobytes()]})

    out = np.zeros(cells, np.uint8)
    for r in pieces.groupBy("seg").applyInPandas(add, "seg int, cls binary").toLocalIterator():
        out[r.seg * _SEGMENT : (r.seg + 1) * _SEGMENT] = np.frombuffer(r.cls, np.uint8)
    return out


def _prefix(tokens: np.ndarray, cls: np.ndarray, similar: int) -> np.ndarray:
    """The rarest tokens: two sets that link have one of these in common."""
    keep = len(tokens) - -(-similar * len(tokens) // 100) + 1
    order = np.argsort(cls[_cell(tokens, len(cls))], kind="stable")  # tokens are sorted by hash
    return tokens[order[:keep]]


#: Sizes and places go along in a byte each: a size as its logarithm to this base, a place as a share of the size, both rounded down.
_STEP = np.log(1.05)


def _may_link(ni, pi, nj, pj, similar: int):
    """Whether sets of sizes ni and nj may link if their first common token stands at pi and pj: what is left of each must hold
    the overlap that two sets of these sizes need."""
    need = similar / (100 + similar) * (ni + nj) - 1e-6
    return (ni - pi >= need) & (nj - pj >= need)


def _may_link_bytes(n: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray, similar: int) -> np.ndarray:
    """The same from rounded sizes and places, never stricter."""
    low, high = np.exp(n * _STEP) - 1, np.where(n == 255, np.inf, np.exp((n + 1) * _STEP) + 1)  # 255 stands for all larger sizes too
    share = similar / (100 + similar)
    fit = lambda i, j: high[i] * (1 - share) - low[i] * (p[i] / 256.0) >= share * low[j]
    return fit(a, b) & fit(b, a)


def _repeated_tokens(texts: DataFrame, cls, similar: int, buckets: int) -> DataFrame:
    """(h, set_id, size, place, first) of the prefix tokens that two or more sets have; size and place as codes; first: the
    first set of the token, if the two may link.

    Of a token that just two sets have, both go if their sizes and places rule a link out.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in pieces(batches, 2048):
            hs, ids, ns, ps = [], [], [], []
            for _, s in shingle_sets(utf8(b.column(1))):
                if (k := set_id(s)) not in seen:
                    seen.add(k)
                    hs.append(_prefix(s, cls.value, similar))
                    m = len(hs[-1])
                    ids.append(np.full(m, k, np.int64))
                    ns.append(np.full(m, min(255, int(np.log(len(s)) / _STEP)), np.uint8))
                    ps.append((np.arange(m) * 256 // len(s)).astype(np.uint8))
            if not hs:
                continue
            v = {"h": np.concatenate(hs), "i": np.concatenate(ids), "n": np.concatenate(ns), "p": np.concatenate(ps)}
            hot = cls.value[_cell(v["h"], len(cls.value))] >= _HOT
            to = (mix(np.where(hot, v["h"] ^ v["i"].view(np.uint64), v["h"])) % np.uint64(buckets)).astype(np.int64)
            out = list(group_rows(v, to))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), *(pa.array([x[c].tobytes() for _, x in out], pa.binary()) for c in "hinp")], names=["bucket", *"hinp"])
        del seen
        give_back()

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        h, i, n, p = (np.frombuffer(b"".join(pdf[c]), t) for c, t in zip("hinp", (np.uint64, np.int64, np.uint8, np.uint8), strict=True))
        order = np.lexsort((i, h))
        h, i = h[order], i[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (i[1:] != i[:-1])
        h, i, n, p = h[new], i[new], n[order][new].astype(np.float64), p[order][new]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(h)))
        two = at[size == 2]
        keep = np.repeat(size > 2, size) | (cls.value[_cell(h, len(cls.value))] >= _HOT)
        fits = _may_link_bytes(n, p, two, two + 1, similar)
        keep[two[fits]] = keep[two[fits] + 1] = True
        centre = np.repeat(at, size)
        star = ~first & _may_link_bytes(n, p, np.arange(len(h)), centre, similar)
        to = pd.array(np.where(star, i[centre], 0), dtype="Int64")
        to[~star] = pd.NA
        give_back()
        return pd.DataFrame({"h": h[keep].view(np.int64), "set_id": i[keep], "size": n[keep].astype(np.int16), "place": p[keep].astype(np.int16), "first": to[keep]})

    packed = texts.mapInArrow(pack, "bucket int, h binary, i binary, n binary, p binary")
    return packed.groupBy("bucket").applyInPandas(repeated, "h long, set_id long, size short, place short, first long")


def _texts_of(texts: DataFrame, wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(set_id, packed) of the wanted sets: a text of each, compressed, found by its hash in ``names`` (set_id, th)."""
    wanted = cut(wanted.join(names, "set_id"))
    keys = wanted.select(F.col("th").alias("key"))
    maybe = lookup(texts.sparkSession, repeated_filter(keys.union(keys), 2 * wanted.count()))

    @F.pandas_udf("boolean")
    def look(key: pd.Series) -> pd.Series:
        return pd.Series(maybe(key.to_numpy(np.int64)))

    @F.pandas_udf("binary")
    def pack(t: pd.Series) -> pd.Series:
        return t.map(lambda x: zlib.compress(x.encode(), 1))

    found = texts.select("th", "t").where(look("th")).dropDuplicates(["th"]).join(wanted, "th")
    return found.select("set_id", pack("t").alias("packed"))


@functools.lru_cache(maxsize=256)
def _unpack(packed: bytes) -> np.ndarray:
    """The tokens of a compressed text."""
    return next(shingle_sets([zlib.decompress(packed)]))[1]


def _linked(a: np.ndarray, b: np.ndarray, similar: int) -> bool:
    if 100 * min(len(a), len(b)) < similar * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similar * (len(a) + len(b) - both)


def _near(pairs: DataFrame, sketches: DataFrame, similar: int) -> DataFrame:
    """The pairs (src, dst) that sizes and bitmaps don't rule out."""

    @F.pandas_udf("boolean")
    def may(n: pd.Series, a: pd.Series, m: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_may_overlap(*x, similar) for x in zip(n, a, m, b, strict=True)], dtype=bool)

    s, t = sketches.toDF("src", "n", "a"), sketches.toDF("dst", "m", "b")
    return pairs.join(s, "src").join(t, "dst").where((100 * F.least("n", "m") >= similar * F.greatest("n", "m")) & may("n", "a", "m", "b")).select("src", "dst")


def _star_links(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs that link, by their tokens."""
    t, u = sets.toDF("src", "a"), sets.toDF("dst", "b")

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_linked(_unpack(x), _unpack(y), similar) for x, y in zip(a, b, strict=True)], dtype=bool)

    return pairs.join(t, "src").join(u, "dst").where(linked("a", "b")).select("src", "dst")


def _named(repeated: DataFrame, groups: DataFrame) -> DataFrame:
    """(h, set_id, size, place, g, members): each token of a set with the set's group, which is the set itself if it has no link yet."""
    return repeated.join(groups.withColumnRenamed("node", "set_id"), "set_id", "left").select("h", "set_id", "size", "place", F.coalesce("component", "set_id").alias("g"), F.coalesce("members", F.lit(1).cast("long")).alias("members"))


def _near_rows(ids: np.ndarray, n: np.ndarray, place: np.ndarray, bits: np.ndarray, block: np.ndarray, a: int, b: int, similar: int) -> Iterator[tuple[int, int]]:
    """The pairs of one token's sets, one of block a and one of block b, that sizes, places and bitmaps don't rule out."""
    one, two = np.flatnonzero(block == a), np.flatnonzero(block == b)
    size = np.array([len(x) for x in bits])
    rest = n - place * n / 256.0  # from the token on; places are rounded down
    for k, i in enumerate(one):
        j = two[k + 1 :] if a == b else two
        need = np.ceil(similar * (n[i] + n[j]) / (100 + similar) - 1e-6)
        j = j[np.minimum(rest[i], rest[j]) >= need - 1e-6]
        x = np.frombuffer(bits[i], np.uint8)
        for w in np.unique(size[j]):
            at = j[size[j] == w]
            y, least = np.frombuffer(b"".join(bits[at]), np.uint8).reshape(len(at), w), min(w, len(x))
            y, z = np.bitwise_or.reduce(y.reshape(len(at), -1, least), axis=1), _fold(x, least)
            need = np.ceil(similar * (n[i] + n[at]) / (100 + similar) - 1e-6)
            may = (np.bitwise_count(z & ~y).sum(axis=1) <= n[i] - need) & (np.bitwise_count(y & ~z).sum(axis=1) <= n[at] - need)
            for other in ids[at[may]]:
                yield int(ids[i]), int(other)


def _single_pairs(named: DataFrame, long: DataFrame, sketches: DataFrame, similar: int) -> DataFrame:
    """(src, dst): the pairs of sets without a group that share a token of ``long`` (h, sets), as far as sizes, places and bitmaps
    admit a link. A token's sets are dealt into blocks and meet in cells of two blocks, so only pairs that may link become rows."""
    blocks = F.ceil(F.col("sets") / BLOCK)
    entries = named.where("members = 1").join(long, "h").select("h", "set_id", "place", F.pmod(F.xxhash64("h", "set_id"), blocks).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    cells = cut(entries.select("h", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "set_id", "place"))
    buckets = max(16, cells.count() // 2000)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[int, int]] = set()
        for (_, a, b), c in pdf.groupby(["h", "a", "b"]):
            c = c.sort_values("set_id")
            found.update(_near_rows(*(c[k].to_numpy() for k in ("set_id", "n", "place", "bits", "block")), a, b, similar))
        give_back()
        return pd.DataFrame([(max(p), min(p)) for p in found], columns=["src", "dst"], dtype="int64")

    dealt = cells.join(sketches, "set_id").select(F.pmod(F.xxhash64("h", "a", "b"), F.lit(buckets)).alias("bucket"), "h", "a", "b", "block", "set_id", "place", "n", "bits")
    return dealt.groupBy("bucket").applyInPandas(run, "src long, dst long").distinct()


def _queries(named: DataFrame, long: DataFrame, similar: int) -> DataFrame:
    """(set_id, g, size): the larger groups that share a prefix token with a set, as far as sizes and places admit a link; without the
    pairs of `_single_pairs`."""
    told = named.join(long.select("h", F.lit(True).alias("long")), "h", "left").where("members > 1 or long is null").select(*named.columns)
    index = told.groupBy("h", F.col("g").alias("to"), F.col("members").alias("to_members")).agg(F.min("size").alias("least"), F.max("size").alias("most"), F.min("place").alias("to_place"))
    larger = (F.col("to_members") > F.col("members")) | (F.col("to_members") == F.col("members")) & (F.col("to") < F.col("g"))
    # the bound of _may_link_bytes at the size of a member that favours it
    share = similar / (100 + similar)
    low = lambda c: F.exp(F.col(c) * _STEP) - 1
    high = lambda c: F.when(F.col(c) < 255, F.exp((F.col(c) + 1) * _STEP) + 1).otherwise(F.lit(float("inf")))
    fits = (high("size") * (1 - share) - low("size") * F.col("place") / 256 >= low("least") * share) & (high("most") * (1 - share) - low("least") * F.col("to_place") / 256 >= low("size") * share)
    return named.join(index, "h").where(larger & (F.col("to") != F.col("g")) & fits).select("set_id", F.col("to").alias("g"), F.col("to_members").alias("members")).distinct()


def _chunked(asked: DataFrame, held: DataFrame, sets: DataFrame, run, schema: str) -> DataFrame:
    """run(queries, members) over buckets of chunks of groups: asked (g, chunk, set_id), held the same, each with what ``sets`` has."""
    n = max(16, asked.count() // 2000, held.count() // 2000)  # either side bounds what a bucket holds
    names = ["bucket", "g", "chunk", "set_id", *sets.columns[1:]]
    bucket = F.pmod(F.xxhash64("g", "chunk"), F.lit(n)).alias("bucket")
    one, two = (x.join(sets, "set_id").select(bucket, *names[1:]).toDF(*names) for x in (asked, held))  # as new columns: both sides come from one table
    return one.groupBy("bucket").cogroup(two.groupBy("bucket")).applyInPandas(run, schema)


def _opened_links(repeated: DataFrame, texts: DataFrame, names: DataFrame, sketches: DataFrame, groups: DataFrame, similar: int) -> DataFrame:
    """A link of each query into each larger group that holds one. A query asks one chunk of a group first, then twice as many each time, and no
    more once it has a link, so those of a large group of near copies don't meet all of its chunks."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    groups = cut(groups.join(sizes, "component").select("node", "component", "members"))
    named = _named(repeated, groups)
    long = cut(named.where("members = 1").groupBy("h").agg(F.count("*").alias("sets")).where(F.col("sets") > LONG))
    near = cut(_single_pairs(named, long, sketches, similar))
    sets = cut(_texts_of(texts, near.select("src").union(near.select("dst")).distinct().toDF("set_id"), names))
    out = cut(_star_links(near, sets, similar))
    discard(near, sets)
    left = queries = cut(_queries(named, long, similar))
    chunks = F.ceil(F.col("members") / MEMBERS)
    wanted = queries.select("g", "members").distinct()
    alone = wanted.where("members = 1").select("g", F.lit(0).cast("long").alias("chunk"), F.col("g").alias("set_id"))
    held = wanted.where("members > 1").select("g").join(groups.toDF("set_id", "g", "members"), "g").select("g", F.pmod(F.xxhash64("set_id"), chunks).alias("chunk"), "set_id")
    held = cut(alone.union(held))
    at, width = 0, 1
    while True:
        turn = lambda k: F.pmod(F.pmod(F.xxhash64("set_id"), chunks) + k, chunks)
        if width == 1:
            asked = cut(left.select("g", turn(F.lit(0)).alias("chunk"), "set_id"))
        else:
            k = F.explode(F.sequence(F.lit(at).cast("long"), F.least(F.lit(at + width), chunks) - 1)).alias("k")
            asked = cut(left.select("g", "set_id", "members", k).select("g", turn(F.col("k")).alias("chunk"), "set_id"))
        part = cut(held.join(asked.select("g", "chunk").distinct(), ["g", "chunk"]))
        found = cut(_chunk_links(asked, part, left, texts, names, sketches, similar))
        out = out.union(found.select("src", "dst"))
        at, width = at + width, 2 * width
        linked = found.select("g", F.col("src").alias("set_id")).distinct()
        left = cut(left.where(chunks > at).join(linked, ["g", "set_id"], "left_anti").select("set_id", "g", "members"))
        if not left.limit(1).count():
            return out


def _chunk_links(asked: DataFrame, held: DataFrame, queries: DataFrame, texts: DataFrame, names: DataFrame, sketches: DataFrame, similar: int) -> DataFrame:
    """(g, src, dst): a link of each query (g, chunk, set_id) into its chunk, if it holds one."""

    def bound(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        """The chunks that a query may overlap enough, by the bitmap of their union."""
        unions: dict[tuple[int, int], np.ndarray] = {}
        for g, c, bits in zip(m["g"], m["chunk"], m["bits"], strict=True):
            x = np.frombuffer(bits, np.uint8)
            if (u := unions.get((g, c))) is not None:
                size = min(len(x), len(u))
                x = _fold(u, size) | _fold(x, size)
            unions[g, c] = x
        out = []
        for g, c, i, n, bits in zip(q["g"], q["chunk"], q["set_id"], q["n"], q["bits"], strict=True):
            if (u := unions.get((g, c))) is not None and 100 * (n - _lacking(np.frombuffer(bits, np.uint8), u)) >= similar * n:
                out.append((g, c, i))
        del unions
        give_back()
        return pd.DataFrame(out, columns=["g", "chunk", "set_id"], dtype="int64")

    opened = cut(_chunked(asked, held, sketches, bound, "g long, chunk long, set_id long"))
    inside = cut(held.join(opened.select("g", "chunk").distinct(), ["g", "chunk"]))
    single = opened.join(queries.where("members = 1").select("g").distinct(), "g")
    # a group of one is its member: both bitmaps decide
    pairs = _near(single.select(F.col("set_id").alias("src"), F.col("g").alias("dst")), sketches, similar)
    opened = cut(opened.join(pairs.toDF("set_id", "g"), ["set_id", "g"], "left_semi").union(opened.join(queries.where("members > 1").select("set_id", "g"), ["set_id", "g"], "left_semi")).select("g", "chunk", "set_id"))
    inside = inside.join(opened.select("g", "chunk").distinct(), ["g", "chunk"])
    sets = cut(_texts_of(texts, opened.select("set_id").union(inside.select("set_id")).distinct(), names))

    def open_groups(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        found = []
        by = {k: v for k, v in m.groupby(["g", "chunk"])}
        for key, ask in q.groupby(["g", "chunk"]):
            if (part := by.get(key)) is None:
                continue
            held_sets = [_unpack(t) for t in part["packed"]]
            size, ids = np.array([len(s) for s in held_sets]), part["set_id"].to_numpy()
            flat, owner = np.concatenate(held_sets), np.repeat(np.arange(len(held_sets)), size)
            order = np.argsort(flat, kind="stable")
            union, start = np.unique(flat[order], return_index=True)
            owner, stop = owner[order], np.append(start[1:], len(flat))
            for s, raw in zip(ask["set_id"], ask["packed"], strict=True):
                t = _unpack(raw)
                at = np.minimum(np.searchsorted(union, t), len(union) - 1)
                at = at[union[at] == t]
                if 100 * len(at) < similar * len(t):
                    continue  # the bound: no member can link
                n = stop[at] - start[at]
                places = np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owner[places], minlength=len(held_sets))
                hit = np.flatnonzero(100 * both >= similar * (len(t) + size - both))
                if len(hit):
                    found.append((int(key[0]), int(s), int(ids[hit[0]])))
        _unpack.cache_clear()
        give_back()
        return pd.DataFrame(found, columns=["g", "src", "dst"], dtype="int64")

    return _chunked(opened, inside, sets, open_groups, "g long, src long, dst long")


def _components(docs: DataFrame, similar: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, th, n_shingles, root, component_id) of each row; root is null for the empty set."""
    spark, texts = docs.sparkSession, _texts(docs, text, doc_id)
    cells = _cells(docs.count())
    both = cut(_classes_and_sketch(texts, cells))
    rows = both.where("seg is null").select("doc_id", "th", "n", "set_id")
    own = both.where("bits is not null").groupBy("set_id").agg(F.min("th").alias("th"), F.min("n").alias("n"), F.first("bits").alias("bits"))
    cls = spark.sparkContext.broadcast(_order(both.where("seg is not null").select("seg", "at", "count"), cells))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    repeated = cut(_repeated_tokens(texts, cls, similar, max(16, total // 1_000_000)))
    wanted = own.join(repeated.select("set_id").distinct(), "set_id", "left_semi")
    known = cut(wanted)
    names, sketches = known.select("set_id", "th"), known.select("set_id", "n", "bits")
    pairs = repeated.where("first is not null").select(F.col("set_id").alias("src"), F.col("first").alias("dst")).distinct()
    near = cut(_near(pairs, sketches, similar))
    sets = cut(_texts_of(texts, near.select("src").union(near.select("dst")).distinct().toDF("set_id"), names))
    stars = cut(_star_links(near, sets, similar))
    discard(near, sets)
    opened = cut(_opened_links(repeated, texts, names, sketches, connected_components(stars), similar))
    found = connected_components(stars.union(opened))
    discard(repeated, known, stars, opened)
    least = rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    named = cut(least.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "least", F.coalesce("component", "set_id").alias("root")))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("set_id", "root").join(roots, "root")
    return rows.join(named, "set_id", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), "root", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def join_classes(docs: DataFrame, similar: int = SIMILAR, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    return _components(docs, similar, text, doc_id).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, similar: int = SIMILAR, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged: of each component the row with the smallest doc_id (null last), then
    the smallest hash of its text; rows without words stay. Only rows that may have to go are shuffled."""
    rows = cut(_components(docs, similar, text, doc_id).where("root is not null").select("root", "doc_id", "th"))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    best = rows.groupBy("root").agg(F.min(row).alias("best"), F.count("*").alias("members")).where("members > 1")
    stay = best.select(F.lit(True).alias("stays"), F.col("best.doc_id").alias("doc_id"), F.col("best.th").alias("th"))
    gone = rows.join(best.select("root"), "root", "left_semi").select("doc_id", "th").distinct()
    a, b = fresh("a", docs.columns), fresh("b", [*docs.columns, "a_"])
    k, c = fresh("k", docs.columns), fresh("c", docs.columns)
    told = gone.join(stay, gone.doc_id.eqNullSafe(stay.doc_id) & (gone.th == stay.th), "left").select(gone.doc_id.alias(a), gone.th.alias(b), F.coalesce("stays", F.lit(False)).alias(k))
    told = cut(told)
    keys = told.select(F.xxhash64(a, b).alias("key"))
    maybe = lookup(docs.sparkSession, repeated_filter(keys.union(keys), 2 * told.count()))

    @F.pandas_udf("boolean")
    def look(key: pd.Series) -> pd.Series:
        return pd.Series(maybe(key.to_numpy(np.int64)))

    i, h = F.col(doc_id).cast("long"), F.xxhash64(F.col(text).cast("string"))
    marked = docs.withColumn(c, look(F.xxhash64(i, h)))
    some = marked.where(c).withColumn(c, h).join(told, i.eqNullSafe(F.col(a)) & (F.col(c) == F.col(b)), "left")
    one = some.where(k).dropDuplicates([doc_id, c])
    return marked.where(~F.col(c)).select(*docs.columns).union(some.where(F.col(k).isNull()).select(*docs.columns)).union(one.select(*docs.columns))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::HUGEINT[]
                                       WHEN len(ws) < 5 THEN [hash(ws)::HUGEINT]
                                       ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: hash(ws[i:i + 4])::HUGEINT)) END AS sh FROM w),
             n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
             e AS (SELECT doc_id, unnest(sh) AS h FROM s),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n_shingles + b.n_shingles - shared)),
             m AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
             r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, m.y FROM r JOIN m ON r.seen = m.x)
        SELECT n.doc_id, n.n_shingles, min(r.seen) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2"""
}
