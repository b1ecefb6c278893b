"""Variants of a group held against their larger peers: at how many times the known error rates would a variant be no surprise?

A variant's differences from a peer are events with tags, and each tag has a rate in the error model, or none (runs beyond its lengths), which then
doesn't count. The joint critical rate of as many positions, over the product of their rates, gives the factor of a pair; the least
over the larger peers is the variant's. The largest variant has none.

Pairs are those of a group, sequences that are equal being compared once. A group of more than ``dense`` variants is blocked first:
a variant meets the ``peers`` nearest of the larger ones that share a piece with it, nearest by edits; leaving far peers out can only raise a
factor, never lower it.

Edge cases: a variant without a sequence has factor 0; one without a pair that can be told (equal sequences, no known rate) has none. A variant too
frequent for any rate has an infinite one. Of equal factors the larger peer comes first, then the smaller name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import run_count
from .graph import candidate_pairs
from .pairwise import differences
from .significance import factor, log_critical_of
from .tables import cut


def known_rates(tags: Column, model: dict[str, float]) -> tuple[Column, Column]:
    """(tags that the model has a rate for, their rates)."""
    table = F.create_map(*(F.lit(x) for kv in model.items() for x in kv))
    rate = lambda t: F.element_at(table, F.regexp_replace(t, "^(hp-l[0-9]+)-.*$", "$1"))
    kept = F.filter(tags, lambda t: F.coalesce((rate(t) > 0) & (rate(t) < 1), F.lit(False)))
    return kept, F.transform(kept, rate)


def larger_peers(variants: DataFrame, keys: list[str], name: str, seq: str, size: str, dense: int = 50, peers: int = 10, piece: int = 16) -> DataFrame:
    """(keys, name, peer, seq, peer_seq): each variant with the larger ones of its group, ties by name; in large groups with the nearest."""
    own = Window.partitionBy(*keys)
    v = variants.where(F.length(seq) > 0).select(*keys, F.col(name).alias("name"), F.col(seq).alias("seq"), F.row_number().over(own.orderBy(F.desc(size), name)).alias("place"), F.count("*").over(own).alias("n"))
    v = cut(v)
    p = v.select(*keys, F.col("name").alias("peer"), F.col("seq").alias("peer_seq"), F.col("place").alias("peer_place"))
    few = v.where(F.col("n") <= dense).join(p, keys).where(F.col("peer_place") < F.col("place"))
    out = few.select(*keys, "name", "peer", "seq", "peer_seq", "peer_place")
    many = v.where(F.col("n") > dense).withColumn("whole", F.concat_ws("/", *keys))
    if many.limit(1).count():
        pairs = candidate_pairs(many, "whole", "place", "seq", piece).select("whole", F.col("dst").alias("place"), F.col("src").alias("peer_place"))
        near = pairs.join(many.select("whole", *keys, "name", "seq", "place"), ["whole", "place"]).join(many.select("whole", F.col("name").alias("peer"), F.col("seq").alias("peer_seq"), F.col("place").alias("peer_place")), ["whole", "peer_place"])
        by = Window.partitionBy("whole", "place").orderBy(F.levenshtein("seq", "peer_seq"), "peer_place")
        near = near.withColumn("r", F.row_number().over(by)).where(F.col("r") <= peers)
        out = out.union(near.select(*keys, "name", "peer", "seq", "peer_seq", "peer_place"))
    return out


def validated(variants: DataFrame, keys: list[str], name: str, seq: str, size: str, model: dict[str, float], dense: int = 50, peers: int = 10) -> DataFrame:
    """(keys, name, cer_factor, cer_pstar, k, n_sites, tags, peer) of each variant; all but cer_factor are those of the pair that decides."""
    v = variants.select(*keys, F.col(name).alias("name"), F.upper(F.coalesce(seq, F.lit(""))).alias("seq"), F.col(size).cast("long").alias("size"))
    own = Window.partitionBy(*keys)
    v = cut(v.withColumn("total", F.sum("size").over(own)).withColumn("place", F.row_number().over(own.orderBy(F.desc("size"), "name"))))
    pairs = larger_peers(v, keys, "name", "seq", "size", dense, peers)
    texts = cut(pairs.select("seq", "peer_seq").distinct())
    kept, rates = known_rates(F.col("x.tags"), model)
    told = texts.withColumn("x", differences("seq", "peer_seq")).select("seq", "peer_seq", kept.alias("tags"), F.aggregate(rates, F.lit(0.0), lambda a, r: a + F.log(r)).alias("expected"))
    longer = F.when(F.length("peer_seq") >= F.length("seq"), F.col("peer_seq")).otherwise(F.col("seq"))
    told = cut(told.where(F.size("tags") > 0).withColumn("k", F.size("tags").cast("long")).withColumn("n_sites", run_count(longer).cast("long")))
    x = pairs.join(told, ["seq", "peer_seq"]).join(v.select(*keys, "name", "size", "total"), [*keys, "name"])
    x = x.withColumn("log_q", log_critical_of("total", "size", "n_sites", "k")).where("log_q is not null and not isnan(log_q)")
    x = x.withColumn("f", factor(F.col("log_q"), F.col("expected"), F.col("k"))).withColumn("q", F.when(F.col("log_q") < float("inf"), F.exp(F.col("log_q") / F.col("k"))))
    best = x.groupBy(*keys, "name").agg(F.min(F.struct("f", "peer_place", F.col("q").alias("cer_pstar"), "k", "n_sites", "tags", "peer")).alias("b"))
    out = v.join(best, [*keys, "name"], "left")
    value = F.when(F.col("place") == 1, F.lit(None)).when(F.col("seq") == "", 0.0).otherwise(F.col("b.f"))
    return out.select(*keys, "name", value.cast("double").alias("cer_factor"), *(F.col(f"b.{c}").alias(c) for c in ("cer_pstar", "k", "n_sites", "tags", "peer")))
