"""Homopolymer observations: how long reads call the runs of their consensus, and the error rates that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alignments import composition, consensus_cells
from .tables import cut


def consensus_runs(rows: DataFrame, group: str, read: str, aligned: str) -> DataFrame:
    """(group, pos, base, start, length): each consensus base with its run; gap columns belong to none."""
    cons = consensus_cells(composition(rows, group, read, aligned), group).where("base <> '-'").select(group, "pos", "base")
    by = Window.partitionBy(group).orderBy("pos")
    isle = cons.withColumn("new", (F.col("base") != F.coalesce(F.lag("base").over(by), F.lit(""))).cast("int")).withColumn("run", F.sum("new").over(by))
    run = Window.partitionBy(group, "run")
    return isle.withColumn("start", F.min("pos").over(run)).withColumn("length", F.count("*").over(run)).select(group, "pos", "base", "start", "length")


def observations(rows: DataFrame, group: str, read: str, aligned: str, least: int = 2) -> DataFrame:
    """(group, start, run_base, length, read, called, status): bases of the run that the read shows between the bases beside it;
    status clean, complex with another base there, full_deletion, or no_coverage where the bases beside it are missing too.

    A group's runs travel to its rows as one array, and each is cut out of the row: no row becomes its cells.
    """
    by = Window.partitionBy(group).orderBy("start")
    r = consensus_runs(rows, group, read, aligned).groupBy(group, "start", "base", "length").agg(F.max("pos").alias("stop"))
    r = r.withColumn("left", F.coalesce(F.lag("stop").over(by), F.lit(-1))).withColumn("right", F.lead("start").over(by)).where(F.col("length") >= least)
    spans = r.groupBy(group).agg(F.collect_list(F.struct("start", "base", "length", "left", "right")).alias("spans"))
    x = rows.select(group, read, F.regexp_replace(F.upper(aligned), "[^ACGT]", "-").alias("row")).join(spans, group).select(group, read, "row", F.explode("spans").alias("x"))
    right = F.coalesce("x.right", F.length("row"))
    bases = F.replace(F.substring("row", F.col("x.left") + 2, right - F.col("x.left") - 1), F.lit("-"), F.lit(""))
    x = x.withColumn("bases", bases).withColumn("called", F.length("bases") - F.length(F.replace("bases", F.col("x.base"), F.lit(""))))
    lost = ((F.col("x.left") >= 0) & (F.substring("row", F.col("x.left") + 1, F.lit(1)) == "-")) & ((right < F.length("row")) & (F.substring("row", right + 1, F.lit(1)) == "-"))
    status = F.when(F.length("bases") > F.col("called"), "complex").when(F.col("called") > 0, "clean").when(lost, "no_coverage").otherwise("full_deletion")
    return x.select(group, "x.start", F.col("x.base").alias("run_base"), "x.length", read, F.col("called").cast("long").alias("called"), status.alias("status"))


def tally(obs: DataFrame, group: str) -> DataFrame:
    """(group, start, run_base, length, called, status, n): clean observations that are alike as one row with their number, computed once. Runs and
    lengths bound the rows, however many the reads; `by_context`, `bimodal` and those of `fitting` take it for the observations."""
    n = obs.where("status = 'clean'").groupBy(group, "start", "run_base", "length", "called", "status").agg(F.count("*").alias("n"))
    return cut(n)


def times(obs: DataFrame) -> Column:
    """How many observations a row stands for."""
    return F.col("n") if "n" in obs.columns else F.lit(1)


def by_context(obs: DataFrame) -> DataFrame:
    """(run_base, length): how often the run is called right, one short, one long, further off; mean and spread."""
    clean = obs.where("status = 'clean'").withColumn("n", times(obs)).withColumn("d", F.col("called") - F.col("length"))
    every = F.sum("n")
    share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)) / every
    d, mean = F.col("d"), F.sum(F.col("called") * F.col("n")) / every
    # around the run's length, so the squares are small whole numbers
    off = F.sum(d * F.col("n")) / every
    spread = F.sqrt(F.greatest(F.sum(d * d * F.col("n")) / every - off * off, F.lit(0.0)))
    return clean.groupBy("run_base", "length").agg(every.alias("n"), share(d == 0).alias("correct"), share(d == -1).alias("minus1"), share(d == 1).alias("plus1"), share(d <= -2).alias("minus2"), share(d >= 2).alias("plus2"), mean.alias("mean"), spread.alias("std"))


def rates(context: DataFrame, most: int = 5) -> DataFrame:
    """(key, rate): one base's error rate by run length, 1 - correct ** (1 / length), weighted over bases."""
    r = context.where(F.col("length") <= most).withColumn("rate", 1 - F.pow("correct", 1 / F.col("length")))
    return r.groupBy(F.concat(F.lit("hp-l"), "length").alias("key")).agg((F.sum(F.col("rate") * F.col("n")) / F.sum("n")).alias("rate"))


def bimodal(obs: DataFrame, context: DataFrame, group: str, least: float = 0.1, ratio: float = 2.0, reads: int = 20) -> DataFrame:
    """(group, start): runs whose second most frequent length has more than ``least`` of the reads and ``ratio`` times what its context shows."""
    clean = obs.where("status = 'clean'")
    n = clean.groupBy(group, "start", "run_base", "length", "called").agg(F.sum(times(obs)).alias("n"))
    by = Window.partitionBy(group, "start")
    second = n.withColumn("all", F.sum("n").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), "called"))).where(F.col("r") == 2)
    c = context.select("run_base", "length", (1 - F.col("correct")).alias("wrong"))
    flagged = second.join(F.broadcast(c), ["run_base", "length"]).where((F.col("all") >= reads) & (F.col("n") > F.col("all") * F.lit(least)) & (F.col("n") / F.col("all") > F.lit(ratio) * F.col("wrong")))
    return flagged.select(group, "start")


def other_errors(rows: DataFrame, group: str, read: str, aligned: str) -> DataFrame:
    """(group, matches, subs, dels, ins, reads): what reads show at consensus bases outside runs, and the bases that they have in columns
    where the consensus has none."""
    comp = composition(rows, group, read, aligned)
    single = consensus_runs(rows, group, read, aligned).where("length = 1").select(group, "pos", F.col("base").alias("c"))
    none = consensus_cells(comp, group).where("base = '-'").select(group, "pos", F.lit("-").alias("c"))
    c = comp.join(single.union(none).hint("merge"), [group, "pos"])
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("long")
    solid, same, gap = F.col("c") != "-", F.col("base") == F.col("c"), F.col("base") == "-"
    counts = c.groupBy(group).agg(n(solid & same).alias("matches"), n(solid & ~same & ~gap).alias("subs"), n(solid & gap).alias("dels"), n(~solid & ~gap).alias("ins"))
    reads = rows.groupBy(group).agg(F.countDistinct(read).alias("reads"))
    return counts.join(reads.hint("merge"), group)


def chimeras(rows: DataFrame, group: str, name: str, size: str, aligned: str, most: int = 6, sites: int = 6, wrong: int = 1, gain: int = 4, side: int = 3) -> DataFrame:
    """(group, candidate, a, b, sites, at, mismatches, gain): the best two larger parents of each candidate, with one breakpoint.

    Only columns where the parents differ count; a prefix follows one parent and the rest the other.
    """
    r = rows.select(group, F.col(name).alias("name"), F.col(size).alias("size"), F.upper(aligned).alias("row"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("size"), "name"))
    r = r.withColumn("rank", rank)
    side_of = lambda p: r.select(F.col(group).alias(f"{p}_g"), *(F.col(c).alias(f"{p}_{c}") for c in ("name", "size", "row", "rank")))
    c, a, b = side_of("c"), side_of("a"), side_of("b")
    triple = c.join(a, (F.col("c_g") == F.col("a_g")) & (F.col("a_size") > F.col("c_size")) & (F.col("a_rank") <= most)).join(b, (F.col("c_g") == F.col("b_g")) & (F.col("b_size") > F.col("c_size")) & (F.col("b_rank") <= most) & (F.col("a_rank") < F.col("b_rank")))
    keys = [F.col("c_g").alias(group), F.col("c_name").alias("candidate"), F.col("a_name").alias("a"), F.col("b_name").alias("b"), F.col("a_rank"), F.col("b_rank")]
    base = lambda row: F.substring(F.col(row), F.col("pos"), F.lit(1))
    col = triple.withColumn("pos", F.explode(F.sequence(F.lit(1), F.length("c_row")))).select(*keys, "pos", base("a_row").alias("x"), base("b_row").alias("y"), base("c_row").alias("z"))
    diag = col.where("x in ('A', 'C', 'G', 'T') and y in ('A', 'C', 'G', 'T') and x <> y").withColumn("da", (F.col("z") != F.col("x")).cast("int")).withColumn("db", (F.col("z") != F.col("y")).cast("int"))
    own = [group, "candidate", "a", "b", "a_rank", "b_rank"]
    by = Window.partitionBy(*own)
    upto = by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = diag.withColumn("n", F.count("*").over(by)).withColumn("i", F.count("*").over(upto))
    for p in ("da", "db"):
        run = run.withColumn(f"{p}_all", F.sum(p).over(by)).withColumn(f"{p}_up", F.sum(p).over(upto))
    ab, ba = F.col("da_up") + F.col("db_all") - F.col("db_up"), F.col("db_up") + F.col("da_all") - F.col("da_up")
    run = run.withColumn("mismatches", F.least(ab, ba)).withColumn("gain", F.least("da_all", "db_all") - F.col("mismatches"))
    ok = run.where((F.col("n") >= sites) & (F.col("mismatches") <= wrong) & (F.col("gain") >= gain) & (F.col("i") >= side) & (F.col("n") - F.col("i") >= side))
    first = F.row_number().over(Window.partitionBy(group, "candidate").orderBy(F.desc("gain"), "mismatches", "a_rank", "b_rank", "pos"))
    return ok.withColumn("r", first).where("r = 1").select(group, "candidate", "a", "b", F.col("n").alias("sites"), (F.col("pos") - 1).cast("long").alias("at"), F.col("mismatches").cast("long"), F.col("gain").cast("long"))
