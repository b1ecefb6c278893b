"""Membership of reads over the later phases of a run: small noisy clusters are disbanded, reads settle, discarded ones are recovered, and the
clusters that changed are phased once more.

The state is a table of (group, cluster, read): one row a read at all times, its cluster null while it's discarded. A phase reads the state,
touches the clusters that concern it, and writes the next one. The last phase looks at clusters whose reads are not those that they began
with, and at no others.

Edge cases: a read without a sequence stays where it is. A group all of whose clusters are disbanded keeps its reads as discards. A cluster that loses
all its reads is gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignments import composition, consensus_cells, without_majority
from .frames import common_columns, consensus_rows
from .phasing import phased
from .reassignment import reassigned, recovered
from .tables import cut, discard


def noisy_clusters(reads: DataFrame, cluster: str, read: str, seq: str, count: int) -> DataFrame:
    """(cluster): clusters of fewer than twice ``count`` reads that have a column of the consensus in which no base has more than half of
    two or more: too few reads to go by, and not of one kind."""
    small = reads.groupBy(cluster).agg(F.count("*").alias("n")).where(F.col("n") < 2 * count).select(cluster)
    rows = common_columns(reads.join(small, cluster, "left_semi"), cluster, read, seq)
    comp = cut(composition(rows, cluster, read, "row_aln"))
    solid = consensus_cells(comp, cluster).where("base <> '-'").select(cluster, "pos")
    return without_majority(comp, cluster).join(solid, [cluster, "pos"], "left_semi").select(cluster).distinct()


def _consensus(reads: DataFrame, keys: list[str], read: str) -> DataFrame:
    """(keys, consensus) of the clusters of reads (keys, read, seq)."""
    whole = reads.withColumn("w", F.struct(*keys))
    rows = consensus_rows(common_columns(whole, "w", read, "seq"), "w")
    return rows.select(*(F.col(f"w.{k}").alias(k) for k in keys), F.replace("consensus", F.lit("-"), F.lit("")).alias("consensus"))


def later_phases(reads: DataFrame, specimen: str, group: str, cluster: str, read: str, seq: str, count: int, frequency: float, identity: float, run: int = 6) -> DataFrame:
    """(specimen, group, cluster, read) after all phases, of reads (specimen, group, cluster, read, seq) whose cluster is null if they are discarded
    to begin with; clusters are named by texts. A cluster that is phased once more gives its name and the path of each part. Discards have null
    groups."""
    keys = [specimen, group, cluster]
    r = reads.select(specimen, F.col(group), F.col(cluster).cast("string").alias(cluster), read, F.upper(F.coalesce(seq, F.lit(""))).alias("seq"))
    r = cut(r)
    own = cut(r.where(F.col(cluster).isNotNull()).withColumn("w", F.struct(*keys)))
    noisy = cut(noisy_clusters(own.where("seq <> ''"), "w", read, "seq", count))
    kept = cut(own.join(noisy, "w", "left_anti"))
    out_of = r.where(F.col(cluster).isNull()).select(specimen, read, "seq").union(own.join(noisy, "w", "left_semi").select(specimen, read, "seq"))
    out_of = cut(out_of)
    # reads settle within their group
    settled = kept.withColumn("g", F.struct(specimen, group))
    settled = cut(reassigned(settled, "g", cluster, read, "seq", run).select(F.col(f"g.{specimen}").alias(specimen), F.col(f"g.{group}").alias(group), cluster, read).join(r.select(specimen, read, "seq"), [specimen, read]))
    # discards find a cluster
    cons = cut(_consensus(settled.where("seq <> ''").select(*keys, read, "seq"), keys, read))
    back = cut(recovered(out_of, cons, specimen, group, cluster, read, "seq", identity, run).select(specimen, group, cluster, read))
    state = cut(settled.select(*keys, read).union(back.select(*keys, read)))
    # clusters whose reads aren't those that they began with
    marks = lambda d: d.groupBy(*keys).agg(F.count("*").alias("mark_n"), F.bit_xor(F.xxhash64(read)).alias("mark_x"), F.sum(F.shiftright(F.xxhash64(read), 16)).alias("mark_s"))
    same = marks(state).join(marks(own), [*keys, "mark_n", "mark_x", "mark_s"], "left_semi").select(*keys)
    changed = cut(state.join(same, keys, "left_anti").join(r.select(specimen, read, "seq"), [specimen, read]).withColumn("w", F.struct(*keys)))
    leaves, _ = phased(changed, "w", read, "seq", count, frequency, run=run)
    named = F.when(F.col("path") == "", F.col(f"w.{cluster}")).otherwise(F.concat(f"w.{cluster}", F.lit("/"), "path"))
    new = cut(leaves.select(F.col(f"w.{specimen}").alias(specimen), F.col(f"w.{group}").alias(group), named.alias(cluster), read))
    final = cut(state.join(same, keys, "left_semi").select(*keys, read).union(new.select(*keys, read)))
    discard(own, noisy, kept, out_of, settled, cons, back, changed)
    rest = r.join(final, [specimen, read], "left_anti").select(specimen, F.lit(None).cast(r.schema[group].dataType).alias(group), F.lit(None).cast("string").alias(cluster), read)
    return final.union(rest)
