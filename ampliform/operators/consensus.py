"""Consensus of reads that are not aligned yet: each is aligned to its group's centre, and columns are counted.

A group's reads are never in one task. Each pair of a read and its centre is aligned by itself, in Arrow batches; what a read
says of the centre's columns, and of what it has between them, is summed map-side before it's exchanged. Equal reads are
aligned once and count as often as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignments import allele_rank
from .pairwise import align

_ROW = T.StructType([T.StructField("row", T.StringType()), T.StructField("more", T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType())])))])


@F.pandas_udf(_ROW)
def _on_centre(centre: pd.Series, seq: pd.Series) -> pd.DataFrame:
    """The read's letter at each of the centre's columns, and what it has after column pos (-1: before all)."""
    out = []
    for c, r in align(centre.tolist(), seq.tolist()):
        row, more, text = [], [], ""
        for x, y in zip(c, r, strict=True):
            if x == "-":
                text += y
                continue
            if text:
                more.append((len(row) - 1, text))
                text = ""
            row.append(y)
        if text:
            more.append((len(row) - 1, text))
        out.append(("".join(row), more))
    return pd.DataFrame(out, columns=["row", "more"])


def centres(classes: DataFrame, group: str, seq: str, copies: str) -> DataFrame:
    """(group, centre): the most frequent sequence of each group, the longest, then first of equals."""
    by = Window.partitionBy(group).orderBy(F.desc(copies), F.desc(F.length(seq)), seq)
    return classes.withColumn("r", F.row_number().over(by)).where("r = 1").select(group, F.col(seq).alias("centre"))


def star_rows(classes: DataFrame, centre: DataFrame, group: str, seq: str) -> DataFrame:
    """``classes`` with row, aligned to the group's centre, and more, what stands between its columns."""
    x = classes.join(centre, group).withColumn("x", _on_centre("centre", seq))
    return x.select(*classes.columns, "x.row", "x.more")


def star_consensus(rows: DataFrame, group: str, copies: str) -> DataFrame:
    """(group, consensus): the most frequent letter of each column, and what more than half of the reads have between columns."""
    cell = rows.select(group, F.col(copies).alias("n"), F.posexplode(F.split("row", "")).alias("pos", "base")).where("base <> ''")
    col = cell.groupBy(group, "pos", "base").agg(F.sum("n").alias("n"))
    top = col.groupBy(group, "pos").agg(F.max_by("base", F.struct(F.col("n"), (-allele_rank(F.col("base"))).alias("rank"))).alias("base"), F.sum("n").alias("total"))
    total = rows.groupBy(group).agg(F.sum(copies).alias("total"))
    more = rows.select(group, F.col(copies).alias("n"), F.explode("more").alias("x")).select(group, "n", F.col("x.pos").alias("pos"), F.posexplode(F.split("x.text", "")).alias("i", "base")).where("base <> ''")
    more = more.groupBy(group, "pos", "i", "base").agg(F.sum("n").alias("n")).join(total, group).where("n * 2 > total")
    both = top.where("base <> '-'").select(group, "pos", F.lit(-1).alias("i"), "base").union(more.select(group, "pos", "i", "base"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "i", "base"))), lambda x: x["base"]), "")
    return both.groupBy(group).agg(text.alias("consensus"))


def aligned_consensus(classes: DataFrame, group: str, seq: str, copies: str, rounds: int = 1) -> DataFrame:
    """(group, consensus) of sequences with their copies; each further round aligns to the consensus of the last."""
    centre = centres(classes, group, seq, copies)
    for _ in range(rounds):
        out = star_consensus(star_rows(classes, centre, group, seq), group, copies)
        centre = out.withColumnRenamed("consensus", "centre")
    return out


def reassigned(classes: DataFrame, consensus: DataFrame, group: str, name: str, seq: str) -> DataFrame:
    """(group, seq, name, edits): each sequence with the nearest consensus of its group, the first by name of equals."""
    pairs = classes.join(consensus.select(group, name, "consensus"), group).withColumn("edits", F.levenshtein(seq, "consensus"))
    return pairs.groupBy(group, seq).agg(F.min(F.struct("edits", F.col(name).alias("name"))).alias("x")).select(group, seq, F.col("x.name").alias(name), "x.edits")
