"""Similarity joins within groups, neighbours, components and clusters."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import bounded_distance
from .tables import cut, discard

#: Reads of a group up to which all its pairs are compared.
PAIRED = 64


def classes(reads: DataFrame, group: str, read: str, seq: str) -> DataFrame:
    """(group, seq, first, copies): equal sequences of a group are compared once."""
    return reads.groupBy(group, seq).agg(F.min(read).alias("first"), F.count("*").alias("copies"))


def candidate_pairs(reads: DataFrame, group: str, read: str, seq: str, k: int) -> DataFrame:
    """(group, src, dst): pairs of a group that share the k-mer at some multiple of k of the one anywhere near in the other.

    Sequences within d edits of each other share one of d + 1 disjoint pieces, moved by at most d: the pieces of one
    are joined to the windows of the other. k is the length of a piece. Windows are many times the reads, which no estimate of
    their size shows, so they are never broadcast.
    """
    piece = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(seq) / k) - 1, F.lit(0))), lambda i: F.substring(F.col(seq), i * k + 1, F.lit(k)))
    window = F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1))), lambda i: F.substring(F.col(seq), i, F.lit(k)))
    a = reads.select(group, F.col(read).alias("src"), F.explode(F.array_distinct(piece)).alias("gram"))
    b = reads.select(group, F.col(read).alias("dst"), F.explode(F.array_distinct(window)).alias("gram"))
    pairs = a.join(b.hint("merge"), [group, "gram"]).where("src <> dst")
    return pairs.select(group, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def edges(reads: DataFrame, group: str, read: str, seq: str, least: float, k: int | None = None) -> DataFrame:
    """(group, src, dst, sim): pairs of a group with similarity ``least`` or more; every pair is tried if k is None.

    With k, groups of at most ``PAIRED`` reads are still tried pair by pair: their pairs are fewer than the windows of their reads.
    """

    def side(r: DataFrame, name: str, text: str) -> DataFrame:
        return r.select(group, F.col(read).alias(name), F.col(seq).alias(text))

    def tried(r: DataFrame) -> DataFrame:
        # scores cost more than rows: so many partitions, however small the reads are
        r = r.repartition(int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")), group)
        return side(r, "src", "a").join(side(r, "dst", "b").hint("merge"), group).where("src < dst")

    def scored(both: DataFrame) -> DataFrame:
        # exploded, a distance is computed once, not by the filter and again for the result
        d = both.withColumn("d", F.explode(F.array(bounded_distance(F.col("a"), F.col("b"), least)))).where("d >= 0")
        return d.withColumn("sim", 1.0 - F.col("d") / F.greatest(F.length("a"), F.length("b"))).where(F.col("sim") >= least).select(group, "src", "dst", "sim")

    if not k:
        return scored(tried(reads))
    large = reads.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > PAIRED).select(group)
    many = reads.join(large, group, "left_semi")
    pairs = candidate_pairs(many, group, read, seq, k)
    found = pairs.join(side(many, "src", "a").hint("merge"), [group, "src"]).join(side(many, "dst", "b").hint("merge"), [group, "dst"])
    return scored(tried(reads.join(large, group, "left_anti"))).union(scored(found))


def nearest(e: DataFrame, group: str, k: int, both_ways: bool = False) -> DataFrame:
    """The k most similar of each source, ties by name."""
    if both_ways:
        e = e.union(e.select(group, F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
    return e.withColumn("r", F.row_number().over(Window.partitionBy(group, "src").orderBy(F.desc("sim"), "dst"))).where(F.col("r") <= k).drop("r")


def weights(e: DataFrame) -> DataFrame:
    """Edges with the square of their similarity, six decimals."""
    return e.withColumn("weight", F.round(F.pow("sim", F.lit(2)), 6))


def connected(e: DataFrame, keys: tuple[str, ...] = (), rounds: int = 100) -> DataFrame:
    """(keys, node, component): the smallest node that each node of the edges (keys, src, dst) reaches; integer nodes.

    Alternating stars: a large step ties every larger neighbour of a node to the smallest node around it, a small step
    ties the smaller neighbours to it. Edges never grow in number, shrink to one a node, and end as stars around the
    smallest nodes; long chains take rounds by their logarithm.
    """
    key = lambda a, b: [F.col(k) for k in keys] + [F.col(a).alias("src"), F.col(b).alias("dst")]
    e = e.where("src <> dst").select(*keys, F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    e = cut(e.distinct())
    state = None
    for _ in range(rounds):
        both = e.union(e.select(*key("dst", "src")))
        low = cut(both.groupBy(*keys, F.col("src").alias("node")).agg(F.min("dst").alias("low")).withColumn("low", F.least("low", "node")))
        large = both.where("dst > src").join(low.withColumnRenamed("node", "src"), [*keys, "src"]).select(*key("dst", "low")).distinct()
        near = large.groupBy(*keys, "src").agg(F.min("dst").alias("low"))
        small = large.join(near, [*keys, "src"]).where("dst <> low").select(*key("dst", "low")).union(near.select(*key("src", "low")))
        new = cut(small.distinct())
        discard(low, e)
        e, before = new, state
        mark = F.xxhash64(*keys, "src", "dst")
        state = e.agg(F.count("*"), F.bit_xor(mark), F.sum(F.shiftright(mark, 32))).first()  # upper halves: the sum holds for 2^32 edges
        if state == before:
            return e.select(*keys, F.col("src").alias("node"), F.col("dst").alias("component")).union(e.select(*keys, "dst", "dst").distinct())
    raise RuntimeError("the stars did not settle")


def components(nodes: DataFrame, e: DataFrame, group: str, read: str) -> DataFrame:
    """(group, read, component): the smallest name that each node reaches within its group, itself if it has no edge."""
    found = connected(e.select(group, "src", "dst"), (group,)).withColumnRenamed("node", read)
    return nodes.select(group, read).distinct().join(found, [group, read], "left").select(group, read, F.coalesce("component", read).alias("component"))


def star_centres(e: DataFrame, group: str) -> DataFrame:
    """(group, centre, degree): the read with most neighbours, the first by name of equals."""
    degree = e.select(group, F.explode(F.array("src", "dst")).alias("node")).groupBy(group, "node").agg(F.count("*").alias("degree"))
    best = F.max_by("node", F.struct("degree", -F.col("node")))
    return degree.groupBy(group).agg(best.alias("centre"), F.max("degree").alias("degree"))


def _both(e: DataFrame, group: str, *more: str) -> DataFrame:
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return e.select(group, F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("x"), *more).select(group, "x.src", "x.dst", *more)


def greedy_clusters(nodes: DataFrame, e: DataFrame, group: str, read: str) -> DataFrame:
    """(group, cluster, read): again and again the read with most free neighbours, the first by name of equals, takes them; what
    is left stands alone. A cluster has its centre's name; integer names.

    A round takes every read that no read within two steps comes before: such reads don't touch each other's stars, so all are
    taken at once, as one after another would be.
    """
    both = cut(_both(e, group).where("src <> dst").distinct())
    out = []
    while both.limit(1).count():
        key = both.groupBy(group, "src").agg(F.struct(F.count("*").alias("k"), (-F.col("src")).alias("name")).alias("own"))
        near = both.join(key.withColumnRenamed("src", "dst"), [group, "dst"]).groupBy(group, "src").agg(F.max("own").alias("near"))
        top = cut(key.join(near, [group, "src"]).select(group, "src", "own", F.greatest("own", "near").alias("one")))
        two = both.join(top.select(group, F.col("src").alias("dst"), "one"), [group, "dst"]).groupBy(group, "src").agg(F.max("one").alias("two"))
        centres = top.join(two, [group, "src"]).where("own = greatest(one, two)").select(group, "src")
        taken = both.join(centres, [group, "src"]).select(group, F.col("src").alias("cluster"), F.col("dst").alias(read))
        taken = cut(taken.union(centres.select(group, "src", "src")))
        gone = taken.select(group, read)
        rest = both.join(gone.withColumnRenamed(read, "src"), [group, "src"], "left_anti").join(gone.withColumnRenamed(read, "dst"), [group, "dst"], "left_anti")
        new = cut(rest.select(group, "src", "dst"))
        discard(both, top)
        both = new
        out.append(taken)
    known = functools.reduce(DataFrame.union, out) if out else None
    alone = nodes.select(group, read).distinct()
    if known is None:
        return alone.select(group, F.col(read).alias("cluster"), read)
    return known.union(alone.join(known.select(group, read), [group, read], "left_anti").select(group, read, read))


def _flow(names: list, src: list, dst: list, weight: list, inflation: float, rounds: int, least: float) -> list:
    """The clusters of a group's sorted names by Markov flow over its matrix."""
    every = np.union1d(names, np.concatenate([src, dst])) if len(src) else np.asarray(names)
    m = np.diag(np.isin(every, names).astype(np.float64))
    i, j = np.searchsorted(every, src), np.searchsorted(every, dst)
    np.add.at(m, (i, j), weight)
    np.add.at(m, (j, i), weight)
    m /= m.sum(axis=0)
    for _ in range(rounds if len(src) else 0):
        new = m @ m
        new = np.power(new / new.max(axis=0), inflation)
        new[new < least] = 0
        new /= new.sum(axis=0)
        still = np.abs(new - m).max() < 1e-8
        m = new
        if still:
            break
    else:
        if len(src):
            raise RuntimeError("the flow did not settle")
    reach = (m > 1e-5) | (m.T > 1e-5) | np.eye(len(m), dtype=bool)
    while (more := reach @ reach).sum() > reach.sum():
        reach = more
    return every[reach.argmax(axis=1)[np.searchsorted(every, names)]].tolist()


def flow_clusters(nodes: DataFrame, e: DataFrame, group: str, read: str, inflation: float = 4.0, rounds: int = 100, least: float = 1e-6) -> DataFrame:
    """(group, cluster, read): Markov flow: column-stochastic weights are squared, raised and pruned until they stand still; reads whose flow ends
    at the same attractors are a cluster, named by its smallest read. An entry goes if it's below the share ``least`` of its column's largest, so
    columns of any number of equal neighbours stay whole. A flow that hasn't settled after ``rounds`` is an error, not an answer.

    Groups of at most ``PAIRED`` reads are exchanged once and flow by themselves, many to a task. The matrices of larger ones are rows
    (group, row, col, w), squared by a join on the shared read, which is never broadcast; groups that stand still leave the rounds."""
    e = cut(e.select(group, "src", "dst", "weight"))
    nodes = cut(nodes.select(group, read).distinct())
    large = cut(nodes.groupBy(group).agg((F.count("*") - F.count(read)).alias("unnamed"), F.count("*").alias("n")).where((F.col("n") > PAIRED) | (F.col("unnamed") > 0)).select(group))

    @F.pandas_udf(T.ArrayType(nodes.schema[read].dataType))
    def flow(names: pd.Series, src: pd.Series, dst: pd.Series, weight: pd.Series) -> pd.Series:
        none = lambda x: [] if x is None else x
        return pd.Series([_flow(n, none(a), none(b), none(w), inflation, rounds, least) for n, a, b, w in zip(names, src, dst, weight, strict=True)])

    own = nodes.join(large, nodes[group].eqNullSafe(large[group]), "left_anti").groupBy(group).agg(F.array_sort(F.collect_set(read)).alias("names"))
    links = e.join(large, group, "left_anti").groupBy(group).agg(F.collect_list(F.struct("src", "dst", "weight")).alias("x"))
    both = own.join(links.hint("merge"), group, "left").select(group, "names", flow("names", "x.src", "x.dst", "x.weight").alias("cluster"))
    small = both.select(group, F.explode(F.arrays_zip("cluster", "names")).alias("x")).select(group, "x.cluster", F.col("x.names").alias(read))
    if not large.limit(1).count():
        return small
    some = nodes.join(large, nodes[group].eqNullSafe(large[group]), "left_semi")
    return small.union(_flow_rounds(some, e.join(large, group, "left_semi"), group, read, inflation, rounds, least))


def _flow_rounds(nodes: DataFrame, e: DataFrame, group: str, read: str, inflation: float, rounds: int, least: float) -> DataFrame:
    def normal(m: DataFrame) -> DataFrame:
        total = m.groupBy(group, "col").agg(F.sum("w").alias("total"))
        return m.join(total, [group, "col"]).select(group, "row", "col", (F.col("w") / F.col("total")).alias("w"))

    loops = nodes.select(group, F.col(read).alias("row"), F.col(read).alias("col"), F.lit(1.0).alias("w"))
    m, settled = cut(normal(loops.union(_both(e, group, "weight")))), []
    for _ in range(rounds):
        left = m.select(group, "row", F.col("col").alias("mid"), F.col("w").alias("v"))
        square = left.join(m.withColumnRenamed("row", "mid").hint("merge"), [group, "mid"]).groupBy(group, "row", "col").agg(F.sum(F.col("v") * F.col("w")).alias("w"))
        # raised as shares of the column's largest, which keeps small numbers from vanishing
        most = square.groupBy(group, "col").agg(F.max("w").alias("most"))
        raised = square.join(most, [group, "col"]).select(group, "row", "col", F.pow(F.col("w") / F.col("most"), F.lit(inflation)).alias("w"))
        new = cut(normal(raised.where(F.col("w") >= least)))
        moved = new.join(m.withColumnRenamed("w", "before"), [group, "row", "col"], "full").where(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))) >= 1e-8)
        moving = cut(moved.select(group).distinct())
        settled.append(cut(new.join(moving, group, "left_anti")))
        going = cut(new.join(moving, group, "left_semi"))
        discard(m, new, moving)
        m = going
        if not m.limit(1).count():
            break
    else:
        raise RuntimeError("the flow did not settle")
    ends = functools.reduce(DataFrame.union, settled)
    links = ends.where("w > 1e-5 and row <> col").select(group, F.col("row").alias("src"), F.col("col").alias("dst"))
    return components(nodes, links, group, read).select(group, F.col("component").alias("cluster"), read)


def linkage_groups(nodes: DataFrame, distances: DataFrame, group: str, read: str, most: float) -> DataFrame:
    """(group, cluster, read): complete linkage, cut at distance ``most``; a pair without a distance is out of reach. The nearest two groups
    join while their farthest members are within reach; ties by the smaller names, which name the groups; integer names.

    Each round joins all pairs that are nearest to each other, which gives what one after another would: a joint group is
    never nearer than its parts. Only pairs within reach are kept, so the state shrinks.
    """
    d = distances.where((F.col("distance") <= most) & (F.col("src") != F.col("dst"))).select(group, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "distance")
    d = cut(d.groupBy(group, "a", "b").agg(F.max("distance").alias("distance")))
    names = cut(nodes.select(group, read, F.col(read).alias("cluster")).distinct())
    while d.limit(1).count():
        pair = d.withColumn("key", F.struct("distance", "a", "b"))
        ends = pair.select(group, F.col("a").alias("n"), "key").union(pair.select(group, F.col("b").alias("n"), "key")).groupBy(group, "n").agg(F.min("key").alias("best"))
        one = pair.join(ends.withColumnRenamed("n", "a"), [group, "a"]).where("key = best").drop("best")
        joined = cut(one.join(ends.withColumnRenamed("n", "b"), [group, "b"]).where("key = best").select(group, "a", "b"))
        to = cut(joined.select(group, F.col("b").alias("n"), F.col("a").alias("into")).union(joined.select(group, F.col("a").alias("n"), F.col("a").alias("into"))))
        moved = d.join(to.toDF(group, "a", "x"), [group, "a"], "left").join(to.toDF(group, "b", "y"), [group, "b"], "left")
        parts = (F.when(F.col("x").isNotNull(), 2).otherwise(1) * F.when(F.col("y").isNotNull(), 2).otherwise(1)).alias("parts")
        moved = moved.select(group, F.coalesce("x", "a").alias("p"), F.coalesce("y", "b").alias("q"), "distance", parts).where("p <> q")
        # a joint group is within reach of another if all its parts are
        new = moved.groupBy(group, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.max("distance").alias("distance"), F.count("*").alias("n"), F.max("parts").alias("parts")).where("n = parts").drop("n", "parts")
        again = cut(new)
        renamed = cut(names.join(joined.select(group, F.col("b").alias("cluster"), F.col("a").alias("into")), [group, "cluster"], "left").select(group, read, F.coalesce("into", "cluster").alias("cluster")))
        discard(d, names, joined, to)
        d, names = again, renamed
    return names.select(group, "cluster", read)
