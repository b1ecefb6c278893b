"""Reads move to the cluster of their group that they agree with where the clusters differ; discarded reads find their way back.

A group's reads come into common columns once. Then rounds: each cluster's consensus is its most frequent letters, the columns in which
two of them have different bases are where a read is asked, and it goes to the cluster that it agrees with most, if it isn't
farther from it, by edits, than from its own. A group's clusters travel to its reads as one array, so no pair of a read and a
cluster is ever a row. Rounds end when no read moves, or when a membership comes again.

Discarded reads meet the consensuses of their specimen that share a piece with them, take the nearest within reach, and are then asked in
the columns of its group.

Edge cases: a group of one cluster keeps its reads. Ties go to the cluster that a read is in, then to the first by name. Reads without a sequence stay
where they are, and discarded ones are lost to all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import class_rows, consensus_rows, of_reads, run_context, scored
from .tables import cut, discard


def normal_rows(reads: DataFrame, group: str, read: str, seq: str, run: int) -> DataFrame:
    """(group, read, row): reads in their group's columns, with the consensus' letter where a run explains a difference. Equal
    sequences of a group are aligned and scored once."""
    found = cut(class_rows(reads, group, seq))
    cons = run_context(consensus_rows(found, group, copies="copies"), group, run)
    rows = cut(scored(found, cons, group).select(group, "seq", F.regexp_replace("normal", "[^ACGT]", "-").alias("row")))
    return of_reads(reads, rows, group, read, seq)


def _at(row: Column, columns: Column) -> Column:
    return F.transform(columns, lambda i: F.substring(row, i + 1, F.lit(1)))


def signatures(consensus: DataFrame, group: str, cluster: str) -> DataFrame:
    """(group, columns, clusters): the columns in which two consensuses (group, cluster, row) have different bases, and (cluster, letters there,
    sequence) of each, by name."""
    cell = consensus.select(group, F.posexplode(F.split("row", "")).alias("pos", "base")).where("base not in ('', '-')")
    col = cell.groupBy(group, "pos").agg(F.countDistinct("base").alias("k")).where("k > 1").groupBy(group).agg(F.array_sort(F.collect_list("pos")).alias("columns"))
    own = consensus.join(col, group).select(group, "columns", F.struct(F.col(cluster).alias("cluster"), _at(F.col("row"), F.col("columns")).alias("letters"), F.replace("row", F.lit("-"), F.lit("")).alias("text")).alias("c"))
    return own.groupBy(group).agg(F.first("columns").alias("columns"), F.array_sort(F.collect_list("c")).alias("clusters"))


def _votes(row: Column, columns: Column, clusters: Column, own: Column) -> Column:
    """The cluster with most agreement; of equals ``own``, then the first."""
    letters = _at(row, columns)
    each = F.transform(clusters, lambda c: F.struct((-F.size(F.filter(F.zip_with(letters, c["letters"], lambda a, b: a == b), lambda x: x))).alias("score"), (~F.coalesce(c["cluster"] == own, F.lit(False))).alias("other"), c["cluster"].alias("cluster"), c["text"].alias("text")))
    return F.array_min(each)


def reassigned(reads: DataFrame, group: str, cluster: str, read: str, seq: str, run: int = 6) -> DataFrame:
    """(group, read, cluster) after the reads of each group have settled."""
    known = reads.select(group, cluster, read, F.upper(F.coalesce(seq, F.lit(""))).alias("seq"))
    rows = cut(normal_rows(known, group, read, "seq", run))
    now = cut(known.select(group, read, cluster))
    states = set()
    while True:
        mark = now.agg(F.bit_xor(F.xxhash64(group, read, cluster)), F.sum(F.shiftright(F.xxhash64(group, read, cluster), 16))).first()
        if tuple(mark) in states:
            return now
        states.add(tuple(mark))
        member = rows.join(now, [group, read])
        cell = member.where("row <> ''").select(group, cluster, F.posexplode(F.split("row", "")).alias("pos", "base")).where("base <> ''").groupBy(group, cluster, "pos", "base").agg(F.count("*").alias("n"))
        top = cell.groupBy(group, cluster, "pos").agg(F.max_by("base", F.struct("n", (-F.instr(F.lit("ACGT-"), F.col("base"))).alias("r"))).alias("base"))
        cons = top.groupBy(group, cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("row"))
        sig = cut(signatures(cons, group, cluster))
        asked = member.where("row <> ''").join(sig, group).withColumn("to", _votes(F.col("row"), F.col("columns"), F.col("clusters"), F.col(cluster)))
        # only reads that would move are measured by edits
        moved = asked.where(F.col("to.cluster") != F.col(cluster)).select(group, read, F.col("to.cluster").alias("to"), F.col("to.text").alias("far"), F.element_at(F.filter("clusters", lambda c: c["cluster"] == F.col(cluster)), 1)["text"].alias("near"))
        moved = moved.join(known.select(group, read, "seq"), [group, read]).where(F.levenshtein("seq", "far") <= F.levenshtein("seq", "near")).select(group, read, "to")
        new = cut(now.join(moved, [group, read], "left").select(group, read, F.coalesce("to", cluster).alias(cluster)))
        discard(now, sig)
        now = new


def nearest_consensus(reads: DataFrame, consensus: DataFrame, specimen: str, read: str, cluster: str, identity: float) -> DataFrame:
    """(specimen, read, cluster, distance): each read (specimen, read, seq) with the nearest consensus (specimen, cluster, text) of its specimen, if its
    distance, in edits over the longer one, is within 1 - ``identity``; the first by name of equals. A sequence within d edits of a
    consensus has one of the d + 1 pieces that make it up, so only what shares a piece is measured."""
    c = consensus.where("text <> ''").select(specimen, cluster, "text").withColumn("d", F.floor(F.length("text") * F.lit(1 - identity) / F.lit(identity)) + 1)
    size = F.greatest(F.floor(F.length("text") / (F.col("d") + 1)), F.lit(1)).cast("int")
    c = cut(c.withColumn("k", size))
    piece = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("d").cast("int")), lambda i: F.substring("text", i * F.col("k") + 1, F.col("k")))))
    pieces = c.select(specimen, cluster, "text", "k", piece.alias("gram"))
    classes = reads.where("seq <> ''").select(specimen, "seq").distinct()
    sizes = c.select(specimen, "k").distinct()
    window = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("seq") - F.col("k") + 1, F.lit(1))), lambda i: F.substring("seq", i, F.col("k")))))
    windows = classes.join(sizes, specimen).select(specimen, "seq", "k", window.alias("gram"))
    pairs = windows.join(pieces, [specimen, "k", "gram"]).select(specimen, "seq", cluster, "text").distinct()
    near = pairs.withColumn("distance", F.levenshtein("seq", "text") / F.greatest(F.length("seq"), F.length("text"))).where(F.col("distance") <= 1 - identity + 1e-12)
    best = near.groupBy(specimen, "seq").agg(F.min(F.struct("distance", F.col(cluster).alias("cluster"))).alias("x"))
    return reads.join(best, [specimen, "seq"]).select(specimen, read, F.col("x.cluster").alias(cluster), "x.distance")


def recovered(discards: DataFrame, consensus: DataFrame, specimen: str, group: str, cluster: str, read: str, seq: str, identity: float, run: int = 6) -> DataFrame:
    """(specimen, group, read, cluster) of the discarded reads that a cluster takes; consensus has (specimen, group, cluster, consensus)."""
    r = cut(discards.select(specimen, read, F.upper(F.coalesce(seq, F.lit(""))).alias("seq")))
    c = cut(consensus.select(specimen, group, cluster, F.upper(F.coalesce("consensus", F.lit(""))).alias("text")).where("text <> ''"))
    near = nearest_consensus(r, c, specimen, read, cluster, identity).join(c.select(specimen, group, cluster), [specimen, cluster])
    near = cut(near.join(r, [specimen, read]).select(specimen, group, read, "seq", F.col(cluster).alias("first")))
    several = c.groupBy(specimen, group).agg(F.count("*").alias("k"))
    alone = near.join(several.where("k = 1"), [specimen, group]).select(specimen, group, read, F.col("first").alias(cluster))
    asked = near.join(several.where("k > 1").select(specimen, group), [specimen, group])
    # consensuses and reads in the same columns
    whole = F.struct(specimen, group)
    both = asked.select(whole.alias("g"), F.struct(F.lit(True).alias("is_read"), F.col(read).cast("string").alias("name")).alias("r"), "seq").union(
        c.join(asked.select(specimen, group).distinct(), [specimen, group]).select(whole.alias("g"), F.struct(F.lit(False).alias("is_read"), F.col(cluster).cast("string").alias("name")).alias("r"), F.col("text").alias("seq"))
    )
    rows = cut(normal_rows(both, "g", "r", "seq", run))
    kind = c.schema[cluster].dataType
    sig = signatures(rows.where("not r.is_read").select("g", F.col("r.name").cast(kind).alias(cluster), "row"), "g", cluster)
    read_rows = rows.where("r.is_read").select("g", F.col("r.name").cast(r.schema[read].dataType).alias(read), "row").join(asked.select(whole.alias("g"), read, "seq", "first"), ["g", read])
    told = read_rows.join(sig, "g", "left").withColumn("to", F.when(F.col("columns").isNotNull(), _votes(F.col("row"), F.col("columns"), F.col("clusters"), F.lit(None).cast(kind))["cluster"]).otherwise(F.col("first")))
    texts = c.select(whole.alias("g"), F.col(cluster).alias("to"), "text")
    fits = told.join(texts, ["g", "to"]).where(F.levenshtein("seq", "text") / F.greatest(F.length("seq"), F.length("text")) <= 1 - identity + 1e-12)
    return alone.union(fits.select(f"g.{specimen}", f"g.{group}", read, F.col("to").alias(cluster)))
