"""Haplotypes out of unaligned reads: align, split at the best column, align the parts again, until no part splits.

All open parts of all groups take a round together, in one job; equal sequences of a part are aligned, scored and asked once. A part's reads come into common columns anew, so what another part's reads had
too many or too few no longer stands between its columns. A column is a variant if an allele besides the first passes both floors among
the reads, or among the ``sample`` best by quality, which a later consensus would see; differences that a run's length explains don't
count. The part splits at the variant column that leaves its parts purest; alleles that pass neither floor are deferred: their reads leave
the part and wait for a later assignment. Parts of fewer than twice ``count`` reads stay whole. A part is always smaller than what it came from,
so rounds end by themselves, at any depth.

Edge cases: a null sequence is empty, and a null quality the lowest; equal qualities go by read. Reads of a null group are left out. A group
that never splits is one leaf with path ''.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alignments import variant_columns
from .frames import class_rows, consensus_rows, run_context, scored
from .tables import cut, discard


def _sampled(reads: DataFrame, part: str, read: str, quality: str, sample: int | None) -> DataFrame:
    """``reads`` with best: whether a read is among the ``sample`` best of its part; all are if the part has no more."""
    if sample is None:
        return reads.withColumn("best", F.lit(True))
    by = Window.partitionBy(part).orderBy(F.desc_nulls_last(quality), read)
    return reads.withColumn("best", F.row_number().over(by) <= sample)


def alleles_at(rows: DataFrame, positions: DataFrame, part: str, read: str, row: str) -> DataFrame:
    """(part, read, copies, some, pos, base): the letters of rows at (part, pos); copies are the reads of a row, some the best of them. A part's
    positions travel as one array."""
    at = positions.groupBy(part).agg(F.collect_set("pos").alias("at"))
    x = rows.join(at, part).select(part, read, "copies", "some", F.col(row).alias("row"), F.explode("at").alias("pos"))
    return x.select(part, read, "copies", "some", "pos", F.substring("row", F.col("pos") + 1, F.lit(1)).alias("base"))


def passing(cells: DataFrame, part: str, count: int, frequency: float) -> DataFrame:
    """(part, pos, base, members): alleles with ``count`` reads and ``frequency`` of them, among all reads or among the best."""
    n = cells.groupBy(part, "pos", "base").agg(F.sum("copies").alias("members"), F.sum("some").alias("some"))
    by = Window.partitionBy(part, "pos")
    n = n.withColumn("all", F.sum("members").over(by)).withColumn("all_some", F.sum("some").over(by))
    ok = lambda x, y: (F.col(x) >= count) & (F.col(x) >= F.col(y) * F.lit(frequency))
    return n.where(ok("members", "all") | ok("some", "all_some")).select(part, "pos", "base", "members")


def split_errors(cells: DataFrame, good: DataFrame, part: str, read: str) -> DataFrame:
    """(part, pos, error): how mixed all variant columns stay, on average, in the parts that a split at this one makes; two alleles must pass."""
    several = good.groupBy(part, "pos").agg(F.count("*").alias("k")).where("k >= 2").select(part, "pos")
    by = cells.join(good.join(several, [part, "pos"]), [part, "pos", "base"]).select(part, read, F.col("pos").alias("by"), F.col("base").alias("allele"), "members")
    inner = by.join(cells.select(part, read, "copies", "pos", "base"), [part, read]).groupBy(part, "by", "allele", "members", "pos", "base").agg(F.sum("copies").alias("n"))
    each = inner.groupBy(part, "by", "allele", "members", "pos").agg((1 - F.max("n") / F.sum("n")).alias("e")).groupBy(part, "by", "allele", "members").agg(F.avg("e").alias("e"))
    return each.groupBy(part, F.col("by").alias("pos")).agg(F.round(F.sum(F.col("e") * F.col("members")) / F.sum("members"), 9).alias("error"))


def phased(reads: DataFrame, group: str, read: str, seq: str, count: int, frequency: float, quality: str | None = None, sample: int | None = None, run: int = 6) -> tuple[DataFrame, DataFrame]:
    """Leaves (group, path, read) and deferred reads (group, path, read); a path has the alleles of the splits, joined by '-'; that of a deferred
    read leads to the part it left."""
    q = F.col(quality) if quality else F.lit(None).cast("double")
    now = cut(reads.where(F.col(group).isNotNull()).select(group, F.lit("").alias("path"), read, F.upper(F.coalesce(seq, F.lit(""))).alias("seq"), q.alias("q")))
    leaves, deferred = [], []
    out = (group, "path", read)
    while now.limit(1).count():
        part = now.withColumn("part", F.concat(F.col(group).cast("string"), F.lit("/"), F.col("path")))
        part = part.withColumn("n", F.count("*").over(Window.partitionBy("part")))
        leaves.append(cut(part.where(F.col("n") < 2 * count).select(*out)))
        open_ = cut(_sampled(part.where(F.col("n") >= 2 * count).drop("n"), "part", read, "q", sample))
        rows = cut(class_rows(open_, "part", "seq"))
        marked = scored(rows, run_context(consensus_rows(rows, "part", copies="copies"), "part", run), "part")
        # a letter that a run explains is no allele of its own column
        plain = F.array_join(F.zip_with(F.split("row_aln", ""), F.split("score", ""), lambda b, s: F.when(s == "=", F.lit(".")).when(b.isin(*"ACGT"), b).otherwise("-")), "")
        marked = marked.where("row_aln <> ''").select("part", "seq", "copies", plain.alias("plain"), F.regexp_replace("normal", "[^ACGT]", "-").alias("normal"))
        best_of = open_.groupBy("part", "seq").agg(F.count_if("best").alias("some")) if sample is not None else None
        marked = cut(marked.join(best_of, ["part", "seq"]) if sample is not None else marked.withColumn("some", F.col("copies")))
        cell = marked.select("part", "copies", "some", F.posexplode(F.split("plain", "")).alias("pos", "base")).where("base not in ('', '.')")
        comp = cell.groupBy("part", "pos", "base").agg(F.sum("copies").alias("n"), F.sum("some").alias("some"))
        both = variant_columns(comp.select("part", "pos", "base", "n"), "part", frequency, count).select("part", "pos")
        if sample is not None:
            both = both.union(variant_columns(comp.where("some > 0").select("part", "pos", "base", F.col("some").alias("n")), "part", frequency, count).select("part", "pos"))
        cells = cut(alleles_at(marked, both, "part", "seq", "normal"))
        good = cut(passing(cells, "part", count, frequency))
        best = cut(split_errors(cells, good, "part", "seq").groupBy("part").agg(F.min(F.struct("error", "pos")).alias("x")).select("part", "x.pos"))
        own = cells.join(best, ["part", "pos"]).join(good.select("part", "pos", "base", F.lit(True).alias("ok")), ["part", "pos", "base"], "left").select("part", "seq", "base", F.coalesce("ok", F.lit(False)).alias("ok"))
        told = cut(open_.join(own, ["part", "seq"], "left").join(best.select("part", F.lit(True).alias("split")), "part", "left"))
        leaves.append(cut(told.where("split is null").select(*out)))
        deferred.append(cut(told.where("split and not coalesce(ok, false)").select(*out)))
        path = F.when(F.col("path") == "", F.col("base")).otherwise(F.concat("path", F.lit("-"), "base"))
        new = cut(told.where("split and ok").select(group, path.alias("path"), read, "seq", "q"))
        discard(now, open_, rows, marked, cells, good, best, told)
        now = new
    union = lambda tables, schema: functools.reduce(DataFrame.union, tables) if tables else schema
    none = now.select(*out)
    return union(leaves, none), union(deferred, none)
