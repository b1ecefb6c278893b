"""Merging of clusters and of groups: by equal sequences up to the length of runs, and by overlap of what different primers amplify.

Clusters meet by hash: first by their sequence with runs cut at a length, which leaves one class of each form, then by the sequence
with every run as one base, under which the few forms that may still be equivalent stand together. In order, a form joins the first
form before it that keeps its own class and is equivalent; forms are decided in rounds of joins, all groups together.

Groups contract in order: the larger anchor takes the smaller one in, and its members bring their links along. What one contraction
at a time gives is single linkage: every linked pair ends in one group, named by its largest anchor. So rounds of stars give the
same, and `contracted` asks only for links of pairs, not for an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import same_primers
from .graph import connected
from .tables import cut, discard


def cut_runs(seq: Column, least: int) -> Column:
    """The sequence with runs of more than ``least`` bases cut to it."""
    for b in "ACGT":
        seq = F.regexp_replace(seq, f"{b}{{{least},}}", b * least)
    return seq


def single_runs(seq: Column) -> Column:
    """The sequence with each run as one base."""
    for b in "ACGT":
        seq = F.regexp_replace(seq, f"{b}+", b)
    return seq


def run_lengths(seq: Column) -> Column:
    return F.transform(F.regexp_extract_all(seq, F.lit("(A+|C+|G+|T+)"), 1), lambda r: F.length(r))


def equivalent(a: Column, b: Column, least: int) -> Column:
    """Whether run lengths, cut at ``least``, differ only in runs of which one has ``least`` bases: how long it is isn't known well."""
    return F.forall(F.zip_with(a, b, lambda x, y: (x == y) | (F.greatest(x, y) >= least)), lambda ok: ok)


def equivalence_classes(clusters: DataFrame, group: str, cluster: str, seq: str, size: str, least: int = 6) -> DataFrame:
    """(group, cluster, into): the cluster that each one merges into, itself if it stays. Clusters come largest first, ties by name; each
    joins the first class that its sequence is equivalent to, or begins one. A null sequence is no cluster's: it stays alone. With ``least``
    of None only equal sequences merge."""
    c = clusters.select(group, cluster, F.col(size).alias("size"), F.upper(seq).alias("seq"))
    form = F.col("seq") if least is None else cut_runs(F.col("seq"), least)
    order = F.struct((-F.col("size")).alias("s"), F.col(cluster).alias("c"))
    c = c.withColumn("form", form).withColumn("order", order)
    forms = c.where("seq is not null").groupBy(group, "form").agg(F.min("order").alias("first"))
    if least is None:
        into = forms.select(group, "form", F.col("first.c").alias("into"))
        return c.join(into, [group, "form"], "left").select(group, cluster, F.coalesce("into", F.col(cluster)).alias("into"))
    forms = cut(forms.withColumn("bare", single_runs(F.col("form"))).withColumn("lengths", run_lengths(F.col("form"))))
    a = forms.select(group, "bare", F.col("first").alias("x"), F.col("lengths").alias("p"))
    b = forms.select(group, "bare", F.col("first").alias("y"), F.col("lengths").alias("q"))
    # x comes before y
    near = cut(a.join(b, [group, "bare"]).where((F.col("x") < F.col("y")) & equivalent(F.col("p"), F.col("q"), least)).select(group, "x", "y"))
    undecided, heads = cut(forms.select(group, "first")), []
    while undecided.limit(1).count():
        waits = near.join(undecided.toDF(group, "x"), [group, "x"], "left_semi").select(group, F.col("y").alias("first")).distinct()
        new = cut(undecided.join(waits, [group, "first"], "left_anti"))
        taken = near.join(new.toDF(group, "x"), [group, "x"], "left_semi").select(group, F.col("y").alias("first")).union(new).distinct()
        rest = cut(undecided.join(taken, [group, "first"], "left_anti"))
        discard(undecided)
        undecided = rest
        heads.append(new)
    head = heads[0] if heads else forms.select(group, "first").where("false")
    for more in heads[1:]:
        head = head.union(more)
    joins = near.join(head.toDF(group, "x"), [group, "x"], "left_semi").groupBy(group, F.col("y").alias("first")).agg(F.min("x").alias("to"))
    joins = joins.join(head, [group, "first"], "left_anti")
    into = forms.join(joins, [group, "first"], "left").select(group, "form", F.coalesce(F.col("to.c"), F.col("first.c")).alias("into"))
    return c.join(into, [group, "form"], "left").select(group, cluster, F.coalesce("into", F.col(cluster)).alias("into"))


def merged_clusters(clusters: DataFrame, classes: DataFrame, group: str, cluster: str, size: str, source: str, allele: str) -> DataFrame:
    """(group, cluster, size, source, allele, merged_from): one record a class, named by its first cluster. Where several merged, source and
    allele are null and merged_from has theirs with their sizes, largest first."""
    x = clusters.join(classes, [group, cluster])
    own = F.struct((-F.col(size)).alias("rank"), F.col(cluster).alias("name"), F.col(source).alias("source"), F.col(allele).alias("allele"), F.col(size).alias("size"))
    m = x.groupBy(group, "into").agg(F.sum(size).alias("size"), F.array_sort(F.collect_list(own)).alias("parts"))
    several = F.size("parts") > 1
    one = lambda f: F.when(~several, F.element_at("parts", 1)[f]).alias(f)
    parts = F.when(several, F.transform("parts", lambda p: F.struct(p["source"].alias("source"), p["allele"].alias("allele"), p["size"].alias("size")))).alias("merged_from")
    return m.select(group, F.col("into").alias(cluster), "size", one("source"), one("allele"), parts)


def contracted(variants: DataFrame, links: DataFrame, specimen: str, group: str, size: str) -> DataFrame:
    """(specimen, group, into): the group that each group ends in, named by the group with the largest anchor, the smaller name of equals, when
    every linked pair (specimen, a, b) of groups contracts, again and again. Integer names."""
    anchors = variants.groupBy(specimen, group).agg(F.max(size).alias("anchor"))
    found = connected(links.select(specimen, F.col("a").alias("src"), F.col("b").alias("dst")), (specimen,)).withColumnRenamed("node", group)
    whole = anchors.join(found, [specimen, group], "left").withColumn("component", F.coalesce("component", group))
    into = F.first(group).over(Window.partitionBy(specimen, "component").orderBy(F.desc("anchor"), group))
    return whole.select(specimen, group, into.alias("into"))


def overlap_links(variants: DataFrame, specimen: str, group: str, seq: str, primers: str, overlap: int, identity: float, least: int = 1) -> DataFrame:
    """(specimen, a, b, distance): pairs of groups of which two members with different primers overlap with a distance below 1 - ``identity``; the
    least distance. Equal sequences of a group with equal primers are compared once, and not those of one primer set."""
    from .overlap import overlap_distance

    v = variants.select(specimen, group, F.col(seq).alias("seq"), F.array_sort(F.array_distinct(primers)).alias("primers")).where("seq <> '' and size(primers) > 0").distinct()
    a, b = v.toDF(specimen, "a", "p", "x"), v.toDF(specimen, "b", "q", "y")
    pairs = a.join(b, specimen).where((F.col("a") < F.col("b")) & ~same_primers(F.col("x"), F.col("y")))
    d = pairs.withColumn("distance", overlap_distance(overlap, least)("p", "q"))
    return d.groupBy(specimen, "a", "b").agg(F.min("distance").alias("distance")).where(F.col("distance") < 1 - identity)
