"""Error models from a run: which observations to trust, and the rates that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import bimodal, by_context, tally, times
from .significance import log_tail_of

#: Lower edges of the bins of reads a cluster.
EDGES = (5, 20, 50, 100, 200, 500, 1000)


def modes(obs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mode): the most frequent value, the smaller of equals."""
    n = obs.groupBy(*keys, value).agg(F.sum(times(obs)).alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct(-F.col("n"), F.col(value).alias("v")))["v"].alias("mode"))


def outliers(obs: DataFrame, context: DataFrame, group: str, alpha: float = 0.01) -> DataFrame:
    """(group, start): runs with more wrong reads than their context's rate allows, over all runs tested."""
    clean = obs.where("status = 'clean'").groupBy(group, "start", "run_base", "length").agg(F.sum(times(obs)).alias("n"), F.sum(F.when(F.col("called") != F.col("length"), times(obs)).otherwise(0)).alias("k"))
    tested = clean.withColumn("tests", F.lit(clean.count()))
    c = context.select("run_base", "length", (1 - F.col("correct")).alias("p"))
    j = tested.join(c, ["run_base", "length"]).where("p > 0 and p < 1 and k > 0")
    return j.where(log_tail_of("k", "n", "p") < F.log(F.lit(alpha) / F.col("tests"))).select(group, "start")


def filtered(obs: DataFrame, flagged: DataFrame, group: str) -> DataFrame:
    return obs.join(flagged.select(group, "start").distinct(), [group, "start"], "left_anti")


def second_pass(obs: DataFrame, group: str, alpha: float = 0.01, least: float = 0.1, ratio: float = 2.0) -> DataFrame:
    """The contexts again, without runs that are outliers or bimodal. Only clean observations count, so their numbers are taken once."""
    obs = tally(obs, group)
    first = by_context(obs)
    return by_context(filtered(obs, outliers(obs, first, group, alpha).union(bimodal(obs, first, group, least, ratio)), group))


def bin_of(reads: Column, edges: tuple[int, ...] = EDGES) -> Column:
    """The label of a cluster's bin; null below the first edge."""
    label = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, [*edges[1:], None], strict=True))):
        label = F.when((reads >= low) & (reads < high if high else F.lit(True)), f"{low}-{high or 'inf'}").otherwise(label)
    return label


def other_rates(counts: DataFrame, reads: str, edges: tuple[int, ...] = EDGES) -> DataFrame:
    """(bin, clusters, sub, indel): error rates outside runs by bin of reads, and over all (bin null), from (matches, subs, dels, ins)."""
    c = counts.withColumn("bin", bin_of(F.col(reads), edges)).where("bin is not null")
    total = F.sum("matches") + F.sum("subs") + F.sum("dels")
    return c.rollup("bin").agg(F.count("*").alias("clusters"), (F.sum("subs") / total).alias("sub"), ((F.sum("dels") + F.sum("ins")) / total).alias("indel"))


def primary(variants: DataFrame, group: str) -> DataFrame:
    """The largest variant of each specimen's first group."""
    by = Window.partitionBy(group).orderBy(F.desc("size"), "ordinal")
    return variants.where("gid = 1").withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def qualifying(anchors: DataFrame, reads: int, err: float) -> DataFrame:
    """Specimens whose primary anchor has ``reads`` reads at least and an error factor below ``err``."""
    return anchors.where((F.col("size") >= reads) & (F.col("err_factor") < err))


def dominant(models: DataFrame, name: str) -> DataFrame:
    """(name, n): the most frequent model, the first by name of equals."""
    return models.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(1)


def critical_rate(log_q: Column, k: Column) -> Column:
    """The whole error rate of a position, over all three other bases, at which a variant at k positions would be no surprise: 3 q."""
    return F.when(log_q.isNull(), 0.0).when(log_q == float("inf"), float("inf")).when(log_q <= -599, 0.0).otherwise(3 * F.exp(log_q / k))


def rate_key(kind: Column, length: Column) -> Column:
    """The key of a difference in an error model: runs by their length alone."""
    return F.when(kind.isin("non-hp-sub", "non-hp-indel"), kind).when(kind == "hp", F.concat(F.lit("hp-l"), length.cast("string")))


def rate_of(key: Column, model: dict[str, float]) -> Column:
    """Its rate; null if the model has none, as for long runs."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in model.items() for x in kv)), key)


def peer_factor(pairs: DataFrame, keys: list[str], factor: str) -> DataFrame:
    """(keys, factor): a candidate's least factor over its larger peers; null without one that can be told."""
    return pairs.groupBy(*keys).agg(F.min(factor).alias(factor))
