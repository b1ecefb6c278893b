"""Curation of consensus variants: ranks, tracks, pruning, selection, merging of fields, allocation of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .parentage import best_larger
from .tables import cut

#: Least critical-error factor and largest error factor of a variant that passes.
MIN_CER, MAX_ERR = 1.0, 1.5


def expected_to_pass(cer: Column, err: Column) -> Column:
    return (cer.isNull() | (cer >= MIN_CER)) & (err.isNull() | (err <= MAX_ERR))


def identity_ranks(variants: DataFrame, specimen: str = "specimen", group: str = "grp") -> DataFrame:
    """``variants`` with gid, the group's place by its largest variant, and vid, the variant's by (passes, size)."""
    own = Window.partitionBy(specimen, group)
    anchors = variants.groupBy(specimen, group).agg(F.max("size").alias("anchor"), F.min("ordinal").alias("first"))
    gid = F.row_number().over(Window.partitionBy(specimen).orderBy(F.desc("anchor"), "first"))
    ranked = variants.join(anchors.withColumn("gid", gid).drop("anchor", "first"), [specimen, group])
    passes = expected_to_pass(F.col("cer_factor"), F.col("err_factor"))
    return ranked.withColumn("vid", F.row_number().over(own.orderBy(F.desc(passes), F.desc("size"), "ordinal")))


def track(cer: Column, err: Column, chimera: Column, min_cer: float = MIN_CER, max_err: float = MAX_ERR) -> Column:
    """lq before chimera before ns before pass; a missing factor passes, and a threshold of 0 is off."""
    low = (err > max_err) if max_err else F.lit(False)
    weak = (cer < min_cer) if min_cer else F.lit(False)
    return F.when(low, "lq").when(chimera.isNotNull(), "chimera").when(weak, "ns").otherwise("pass")


def pruned_groups(variants: DataFrame, ratio: float, count: int, specimen: str = "specimen") -> DataFrame:
    """(specimen, gid, total, pruned): a group goes if it's below both the ratio to the specimen's largest and the count; the first never does."""
    totals = variants.groupBy(specimen, "gid").agg(F.sum("size").alias("total"))
    largest = F.max("total").over(Window.partitionBy(specimen))
    return totals.withColumn("pruned", (F.col("gid") != 1) & (F.col("total") < largest * F.lit(ratio)) & (F.col("total") < count))


def selected(variants: DataFrame, most: int, ratio: float = 0.0, specimen: str = "specimen") -> DataFrame:
    """The ``most`` largest variants of each group (all if 0), at least ``ratio`` of the largest; equals of the largest stay."""
    by = Window.partitionBy(specimen, "gid")
    r = variants.withColumn("r", F.row_number().over(by.orderBy(F.desc("size"), "ordinal"))).withColumn("largest", F.max("size").over(by))
    r = r.where((F.col("size") == F.col("largest")) | (F.col("size") >= F.col("largest") * F.lit(ratio)))
    return (r.where(F.col("r") <= most) if most > 0 else r).drop("r", "largest")


def gated(variants: DataFrame, frequency: float, specimen: str = "specimen") -> DataFrame:
    """Variants by size as long as each has ``frequency`` of the sizes before it; the first that hasn't ends its group."""
    by = Window.partitionBy(specimen, "gid").orderBy(F.desc("size"), "ordinal")
    before = F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ok = variants.withColumn("ok", (F.col("size") >= before * F.lit(frequency)).cast("int"))
    return ok.withColumn("all_ok", F.min("ok").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("all_ok = 1").drop("ok", "all_ok")


def allocated(variants: DataFrame, budget: int, specimen: str = "specimen") -> DataFrame:
    """``variants`` with reads: the budget by size, whole shares first, then one each by the largest remainder."""
    by = Window.partitionBy(specimen, "gid")
    share = F.col("size") * F.lit(float(budget)) / F.sum("size").over(by)
    s = variants.withColumn("share", share).withColumn("whole", F.floor("share")).withColumn("rest", F.round(F.col("share") - F.col("whole"), 9))
    s = s.withColumn("missing", F.lit(budget) - F.sum("whole").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("rest"), F.desc("size"), "ordinal")))
    fits = F.sum("size").over(by) <= budget
    reads = F.when(fits, F.col("size")).otherwise(F.col("whole") + (F.col("r") <= F.col("missing")).cast("int"))
    return s.withColumn("reads", reads.cast("long")).drop("share", "whole", "rest", "missing", "r")


def merged(variants: DataFrame, keys: list[str]) -> DataFrame:
    """One record per key: sizes and reads summed, contributors' reads and lengths largest first, primers united, the rest of the largest."""
    down = lambda x: F.array_join(F.reverse(F.array_sort(F.collect_list(x))).cast("array<string>"), "+")
    return variants.groupBy(*keys).agg(
        F.sum("size").alias("size"), F.sum("ric").alias("ric"), down("ric").alias("raw_ric"), down(F.length("seq")).alias("raw_len"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("primers")))), ",").alias("primers"), F.max_by("seq", F.struct("size", -F.col("ordinal"))).alias("seq"),
    )


def within_limits(stats: DataFrame, most_snps: int, most_indels: int, longest_indel: int) -> Column:
    """Whether a set of variants may be merged: its differences, with those of earlier rounds, stay within the limits."""
    return (F.col("snps") + F.col("prior_snps") <= most_snps) & (F.col("indels") + F.col("prior_indels") <= most_indels) & (F.col("indel_length") <= longest_indel)


def groups_by_anchor(variants: DataFrame, most: int, specimen: str = "specimen") -> DataFrame:
    """Variants of the ``most`` groups with the largest anchors."""
    a = variants.groupBy(specimen, "gid").agg(F.max("size").alias("anchor"))
    top = a.withColumn("r", F.row_number().over(Window.partitionBy(specimen).orderBy(F.desc("anchor"), "gid"))).where(F.col("r") <= most)
    return variants.join(top.select(specimen, "gid"), [specimen, "gid"], "left_semi")


def calibration(variants: DataFrame, track: str, observed: str, expected: str, columns: str, low: float = 0.7, high: float = 1.4, least: int = 5000) -> DataFrame:
    """(track, clusters, ratio, enough, within): observed over expected errors by track, and over all (track null)."""
    c = variants.rollup(track).agg(F.count("*").alias("clusters"), (F.sum(observed) / F.sum(expected)).alias("ratio"), (F.sum(columns) >= least).alias("enough"))
    return c.withColumn("within", F.coalesce(F.round("ratio", 6).between(low, high), F.lit(False)))


def parameter_signals(variants: DataFrame, max_err: float = MAX_ERR) -> DataFrame:
    """One row of what may suggest other parameters: passing variants just under the thresholds, and unusual routing."""
    passed, n = F.col("track") == "pass", F.count("*")
    pct = lambda t: F.round(100.0 * F.count_if(F.col("track") == t) / n, 6)
    raw = lambda t: 100.0 * F.count_if(F.col("track") == t) / n
    return variants.agg(
        F.count_if(passed).alias("passed"), F.count_if(passed & (F.col("err_factor") > 1.3) & (F.col("err_factor") <= max_err)).alias("high_err"), F.count_if(passed & (F.col("cer_factor") > 1.0) & (F.col("cer_factor") <= 1.1)).alias("border_cer"),
        pct("ns").alias("ns_pct"), pct("lq").alias("lq_pct"), ((raw("ns") > 50) | (raw("lq") > 20)).alias("unusual"),
    )


def summary_rows(variants: DataFrame, specimen: str, order: list[str]) -> DataFrame:
    """``variants`` with multiple, the record's running number within its specimen."""
    return variants.withColumn("multiple", F.row_number().over(Window.partitionBy(specimen).orderBy(*order)))


def parents(variants: DataFrame, keys: list[str]) -> DataFrame:
    """(ordinal, parent, parent_size, identity, edits): of each variant but the anchor the most similar larger one of its group, or the
    anchor; of equals the larger, then the first. Equal sequences are looked up once: one that isn't the largest of its sequence has that as parent."""
    own = Window.partitionBy(*keys, "seq").orderBy(F.desc("size"), "ordinal")
    v = variants.dropna(subset=keys).select(*keys, "ordinal", "size", "seq")
    v = cut(v.withColumn("top", F.first("ordinal").over(own)).withColumn("top_size", F.first("size").over(own)))
    first = F.max_by(F.struct("ordinal", "size", "seq"), F.struct("size", -F.col("ordinal")))
    anchors = v.groupBy(*keys).agg(first.alias("anchor"))
    found = best_larger(v.where("ordinal = top and seq is not null"), keys).withColumnRenamed("ordinal", "top")
    x = v.join(anchors, keys).where(F.col("ordinal") != F.col("anchor.ordinal")).join(found, [*keys, "top"], "left")
    edits = F.levenshtein("seq", "anchor.seq")
    whole = F.when(F.greatest(F.length("seq"), F.length("anchor.seq")) == 0, 1.0).otherwise(1 - edits / F.greatest(F.length("seq"), F.length("anchor.seq"), F.lit(1)))
    told = lambda parent, size, identity, e: F.struct(parent.alias("parent"), size.alias("parent_size"), identity.alias("identity"), e.alias("edits"))
    same = F.col("seq").isNotNull() & F.coalesce((F.col("top_size") > F.col("size")) | (F.col("top") == F.col("anchor.ordinal")), F.lit(False))
    alone = F.col("seq").isNull() | F.col("size").isNull() | F.col("parent").isNull()  # nothing is larger, or comparable: the anchor
    best = F.when(same, told(F.col("top"), F.col("top_size"), F.lit(1.0), F.lit(0))).when(alone, told(F.col("anchor.ordinal"), F.col("anchor.size"), whole, edits)).otherwise(told(*map(F.col, ("parent", "parent_size", "identity", "edits"))))
    return x.select("ordinal", best.alias("x")).select("ordinal", "x.*")


def specimens(variants: DataFrame, specimen: str) -> DataFrame:
    """(specimen, clusters, passed, yield_pct, tracks): a specimen's variants over all tracks."""
    passed = F.sum(F.when(F.col("track") == "pass", F.col("size")).otherwise(0))
    return variants.groupBy(specimen).agg(F.count("*").alias("clusters"), passed.alias("passed"), F.round(100.0 * passed / F.sum("size"), 6).alias("yield_pct"), F.array_join(F.array_sort(F.collect_set("track")), ",").alias("tracks"))


def mergeable(variants: DataFrame, keys: list[str], aligned: str, most: int, snps: int, indels: int) -> DataFrame:
    """(keys, mask, size, snps): the largest subset of each group's ``most`` largest variants whose columns differ in ``snps`` places and
    have gaps beside bases in ``indels`` at most. Subsets are bit masks, and so is who has which base in a column: no subset of rows is made."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("size"), "ordinal")) - 1
    v = variants.withColumn("place", place).where(F.col("place") < most).withColumn("bit", F.call_function("shiftleft", F.lit(1), F.col("place")))
    cell = v.select(*keys, "bit", F.posexplode(F.split(F.upper(aligned), "")).alias("pos", "base")).where("base <> ''")
    who = lambda b: F.coalesce(F.bit_or(F.when(F.col("base") == b, F.col("bit"))), F.lit(0)).alias(f"has_{b}")
    col = cell.groupBy(*keys, "pos").agg(*(who(b) for b in "ACGT"), F.coalesce(F.bit_or(F.when(F.col("base") == "-", F.col("bit"))), F.lit(0)).alias("gap"))
    masks = F.explode(F.sequence(F.lit(1), F.lit((1 << most) - 1))).alias("mask")
    m = F.col("mask")
    kinds = sum(((F.col(f"has_{b}").bitwiseAND(m)) != 0).cast("int") for b in "ACGT")
    gap = F.col("gap").bitwiseAND(m) != 0
    stats = col.select("*", masks).groupBy(*keys, "mask").agg(F.count_if((kinds > 1) & ~gap).alias("snps"), F.count_if((kinds > 0) & gap).alias("indels"))
    size = v.select(*keys, "bit", "size", masks).where(F.col("bit").bitwiseAND(m) != 0).groupBy(*keys, "mask").agg(F.sum("size").alias("size"))
    ok = stats.where((F.col("snps") <= snps) & (F.col("indels") <= indels)).join(size, [*keys, "mask"])
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("size"), "mask"))
    return ok.withColumn("r", first).where("r = 1").select(*keys, "mask", "size", "snps")


def nearest_groups(variants: DataFrame, specimen: str) -> DataFrame:
    """(specimen, gid, mate, edits): of each group the later group of its specimen whose anchor is nearest, the first of equals."""
    a = variants.groupBy(specimen, "gid").agg(F.max_by("seq", F.struct("size", -F.col("ordinal"))).alias("seq"))
    b = a.select(specimen, F.col("gid").alias("mate"), F.col("seq").alias("mate_seq"))
    pairs = a.join(b, specimen).where("gid < mate").withColumn("edits", F.levenshtein("seq", "mate_seq"))
    return pairs.groupBy(specimen, "gid").agg(F.min(F.struct("edits", "mate")).alias("x")).select(specimen, "gid", "x.mate", "x.edits")
