"""Embedding near-dedup: NN-descent over cosine similarity.

Equal vectors are one class. The neighbour graph begins with lists of ``K`` found in blocks of a few random
hyperplane codes, and is refined by local joins: each round brings together, at every vector, its neighbours and those
that have it as a neighbour, and each pair that improves a list enters it, until hardly any does. Pairs at or above the
threshold, checked in double precision, are links. Lists may be full of nearer vectors, so
their components are joined by an exact comparison: each is split into narrow pieces, all pieces' centres are compared
in blocks, and the members of pieces of two components where the triangle inequality admits a link. Members of a
component are compared in blocks to count links, so no pair of a large group is ever a row. What
the lists miss, for whatever reason, is found there: they save work, and the result does not depend on their recall. The
comparison of centres grows with the square of the number of pieces (of classes, where hardly any are near).

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of
different length never link; rows that repeat a vec_id are vectors of their own, and null ids never name a component; an empty table gives an empty result; extra
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, cut

#: Length of a list, codes to begin with, vectors of a block, rounds, share of lists' entries that ends them.
K, CODES, BLOCK, ROUNDS, STILL = 10, 4, 512, 4, 0.02
#: The widest angle (radians) between the first vector of a piece and another.
NARROW = 0.25


def _classes(vectors: DataFrame, embedding: str, vec_id: str) -> DataFrame:
    """(vec_id, v): v is the vector in double precision, null if it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                a = np.array(x, np.float64) if x and None not in x else np.zeros(1)
                out.append(a.tobytes() if np.isfinite(a).all() and a.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).mapInArrow(run, "vec_id long, v binary")


def _unit(rows: pd.Series) -> np.ndarray:
    """The vectors, scaled to length one; by their largest component first, so nothing overflows."""
    x = np.stack([np.frombuffer(r) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(found: DataFrame) -> DataFrame:
    """(u, v, sim): the K best of each list."""
    top = F.slice(F.sort_array(F.collect_set(F.struct("sim", "v")), asc=False), 1, K)
    return found.groupBy("u").agg(top.alias("top")).select("u", F.explode("top").alias("t")).select("u", F.col("t.v").alias("v"), F.col("t.sim").alias("sim"))


def _first_lists(units: DataFrame, n: int, codes: range) -> DataFrame:
    bits = max(1, (n // 128).bit_length())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].str.len() // 8):
                x = _unit(part["v"])
                for c in codes:
                    plane = np.random.default_rng([c, int(dim)]).standard_normal((int(dim), bits))
                    code = (x @ plane > 0) @ (1 << np.arange(bits))
                    yield pd.DataFrame({"part": c * 4096 + int(dim) % 4096, "code": code.astype(np.int64), "id": part["id"], "v": part["v"]})

    coded = units.select("id", "v").mapInPandas(encode, "part long, code long, id long, v binary")
    sizes = units.select("id", "v").mapInPandas(encode, "part long, code long, id long, v binary").groupBy("part", "code").agg(F.count("*").alias("n"))
    split = coded.join(sizes, ["part", "code"]).withColumn("piece", F.pmod(F.xxhash64("id", "part"), F.ceil(F.col("n") / (2 * BLOCK))))
    packed = split.withColumn("bucket", F.pmod(F.xxhash64("part", "code", "piece"), F.lit(max(16, n * len(codes) // 4000))))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby([pdf["part"], pdf["code"], pdf["piece"], pdf["v"].str.len()]):
            if len(g) > 1:
                x, ids = _unit(g["v"]).astype(np.float32), g["id"].to_numpy()
                s = x @ x.T
                np.fill_diagonal(s, -2)
                k = min(K, len(ids) - 1)
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                out.append(pd.DataFrame({"u": np.repeat(ids, k), "v": ids[best].ravel(), "sim": np.take_along_axis(s, best, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"u": pd.Series([], dtype="int64"), "v": pd.Series([], dtype="int64"), "sim": pd.Series([], dtype="float32")})

    return packed.select("bucket", "part", "code", "piece", "id", "v").groupBy("bucket").applyInPandas(compare, "u long, v long, sim float")


def _local_join(lists: DataFrame, units: DataFrame, n: int) -> DataFrame:
    """Pairs of vectors with a common neighbour that improve a list."""
    back = lists.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))).where(f"r <= {K}")
    around = lists.select(F.col("u").alias("at"), F.col("v").alias("id")).union(back.select(F.col("v").alias("at"), F.col("u").alias("id"))).distinct()
    worst = lists.groupBy(F.col("u").alias("id")).agg(F.when(F.count("*") < K, F.lit(-2.0)).otherwise(F.min("sim")).cast("float").alias("worst"))
    rows = around.join(units.select("id", "v").join(worst, "id"), "id").withColumn("bucket", F.pmod(F.xxhash64("at"), F.lit(max(16, n // 1000))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        us, vs, ss = [], [], []
        pdf = pdf.sort_values("at", kind="stable")
        at, ids, worst = pdf["at"].to_numpy(), pdf["id"].to_numpy(), pdf["worst"].to_numpy(np.float32)
        size = pdf["v"].str.len().to_numpy()
        edge = np.flatnonzero(np.diff(at)) + 1
        for a, b in zip([0, *edge], [*edge, len(at)], strict=True):
            if b - a > 1 and (size[a:b] == size[a]).all():
                x = _unit(pdf["v"].iloc[a:b]).astype(np.float32)
                s = x @ x.T
                np.fill_diagonal(s, -3)
                i, j = np.nonzero(s > worst[a:b, None])
                us.append(ids[a:b][i])
                vs.append(ids[a:b][j])
                ss.append(s[i, j])
        if not us:
            return pd.DataFrame({"u": pd.Series([], dtype="int64"), "v": pd.Series([], dtype="int64"), "sim": pd.Series([], dtype="float32")})
        return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs), "sim": np.concatenate(ss)}).drop_duplicates(["u", "v"])

    return rows.select("bucket", "at", "id", "v", "worst").groupBy("bucket").applyInPandas(run, "u long, v long, sim float")


def _refine(lists: DataFrame, units: DataFrame, n: int) -> DataFrame:
    for _ in range(ROUNDS):
        new = cut(_best(lists.union(_local_join(lists, units, n))))
        changed = new.join(lists.select("u", "v"), ["u", "v"], "left_anti").count()
        lists = new
        if changed <= STILL * K * n:
            break
    return lists


def _links(lists: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """Pairs of the lists whose cosine, in double precision, reaches the threshold."""
    pairs = lists.where(F.col("sim") >= threshold - 1e-3).select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()
    a, b = units.select(F.col("id").alias("src"), F.col("v").alias("a")), units.select(F.col("id").alias("dst"), F.col("v").alias("b"))

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=a.index)
        for _, own in a.groupby(a.str.len()):
            out[own.index] = np.einsum("ij,ij->i", _unit(own), _unit(b[own.index]))
        return out

    return pairs.join(a, "src").join(b, "dst").where(cosine("a", "b") >= threshold).select("src", "dst")


def _pieces(parts: DataFrame, units: DataFrame) -> DataFrame:
    """(piece, component, v, centre, radius, ids): the classes of each component in pieces of ``BLOCK`` at most, none
    further than ``NARROW`` from the piece's first; a class outside all components is a piece of its own."""
    named = units.join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", "v", F.coalesce("component", "id").alias("component"))
    sizes = named.groupBy("component").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("slices"))
    dealt = named.join(sizes, "component").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("component", "slice"), F.lit(max(16, units.count() // 2000))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (component, _, size), g in pdf.groupby(["component", "slice", pdf["v"].str.len()]):
            x, ids, raw = _unit(g["v"]), g["id"].to_numpy(), g["v"].to_numpy()
            left = np.arange(len(ids))
            while len(left):
                angle = np.arccos(np.clip(x[left] @ x[left[0]], -1, 1))
                angle[0] = 0
                near = np.flatnonzero(angle <= NARROW)[:BLOCK]
                own = left[near]
                out.append((int(ids[own[0]]), int(component), b"".join(raw[own]), raw[own[0]], float(angle[near].max()), ids[own].astype(np.int64).tobytes()))
                left = np.delete(left, near)
        return pd.DataFrame(out, columns=["piece", "component", "v", "centre", "radius", "ids"])

    return dealt.select("bucket", "component", "slice", "id", "v").groupBy("bucket").applyInPandas(run, "piece long, component long, v binary, centre binary, radius double, ids binary")


def _bridges(parts: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """Links between components, whatever the lists hold: one of each two pieces that have any. All pieces' centres are
    compared in blocks; by the triangle inequality only pieces whose centres are near enough can hold a link."""
    pieces = cut(_pieces(parts, units))
    n = pieces.count()
    blocks = -(-n // min(4096, max(128, n // 16))) if n else 1
    block = F.pmod(F.xxhash64("piece", F.lit(7)), F.lit(blocks))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    spread = pieces.select("piece", "component", "centre", "radius", block.alias("block")).withColumn("pair", F.explode(pair)).select("pair.i", "pair.j", "block", "piece", "component", "centre", "radius")
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-5

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"p": np.empty(0, np.int64), "q": np.empty(0, np.int64)})]
        (i, j), size = pdf[["i", "j"]].iloc[0], pdf["centre"].str.len()
        for _, g in pdf.groupby(size):
            x, name, part, radius, at = _unit(g["centre"]), g["piece"].to_numpy(), g["component"].to_numpy(), g["radius"].to_numpy(), g["block"].to_numpy()
            a, b = np.flatnonzero(at == i), np.flatnonzero(at == j)
            if len(a) and len(b):
                least = np.cos(np.minimum(radius[a, None] + radius[b] + reach, np.pi))
                u, v = np.nonzero((x[a] @ x[b].T >= least) & (part[a, None] != part[b]))
                u, v = name[a[u]], name[b[v]]
                on = u < v if i == j else np.ones(len(u), bool)
                out.append(pd.DataFrame({"p": u[on], "q": v[on]}))
        return pd.concat(out)

    pairs = cut(spread.groupBy("i", "j").applyInPandas(near, "p long, q long"))
    left = pieces.select(F.col("piece").alias("p"), F.col("v").alias("a"), F.col("ids").alias("a_ids"), F.col("centre").alias("ca"))
    right = pieces.select(F.col("piece").alias("q"), F.col("v").alias("b"), F.col("ids").alias("b_ids"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for a, ai, c, b, bi in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                x, y = (_unit([v[k : k + len(c)] for k in range(0, len(v), len(c))]) for v in (a, b))
                hit = x @ y.T >= threshold
                if hit.any():
                    u, v = np.unravel_index(hit.argmax(), hit.shape)
                    src.append(np.frombuffer(ai, np.int64)[u])
                    dst.append(np.frombuffer(bi, np.int64)[v])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    both = pairs.join(left, "p").join(right, "q").select("a", "a_ids", "ca", "b", "b_ids")
    return both.mapInArrow(compare, "src long, dst long")


def _count_links(parts: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """(id, links): the copies of other classes that link with each, within its component, block against block."""
    sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = parts.withColumnRenamed("node", "id").join(sizes, "component").join(units, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    spread = members.withColumn("pair", F.explode(pair)).select("component", "pair.i", "pair.j", "block", "id", "copies", "v")
    n = max(16, parts.count() // 500)
    spread = spread.withColumn("bucket", F.pmod(F.xxhash64("component", "i", "j"), F.lit(n)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), g in pdf.groupby(["component", "i", "j"]):
            x, copies, ids, block = _unit(g["v"]), g["copies"].to_numpy(), g["id"].to_numpy(), g["block"].to_numpy()
            a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
            hit = x[a] @ x[b].T >= threshold
            if i == j:
                np.fill_diagonal(hit, False)
            out.append(pd.DataFrame({"id": ids[a], "links": hit @ copies[b]}))
            if i != j:
                out.append(pd.DataFrame({"id": ids[b], "links": hit.T @ copies[a]}))
        return pd.concat(out).astype("int64")

    return spread.groupBy("bucket").applyInPandas(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, embedding: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    rows = cut(_classes(vectors, embedding, vec_id))
    # a class has the hash of its vector as name, as vec_ids may repeat or be null
    units = cut(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("id", F.xxhash64("v")))
    n = units.count()
    lists = _refine(cut(_best(_first_lists(units, n, range(CODES)))), units, n)
    found = cut(_links(lists, units, threshold))
    parts = connected_components(found)
    parts = connected_components(found.union(_bridges(parts, units, threshold)))
    links = _count_links(parts, units, threshold)
    classes = cut(units.join(parts.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left").withColumn("root", F.coalesce("component", "id")))
    roots = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(roots, "root").select(F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(named, rows.v == named.w, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = {
    "op4_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
                              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
             r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.y FROM r JOIN l ON r.seen = l.x),
             c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1),
             n AS (SELECT x, count(*) AS k FROM l GROUP BY 1)
        SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON x = vec_id"""
}
