"""Reads of a group in common columns, out of reads that are not aligned yet.

A frame is a group's row of columns. It begins as the bases of the group's centre, its most frequent sequence; each distinct sequence is
aligned to it by itself, in Arrow batches, and again to the consensus that this gives. What sequences have between two columns
widens the frame there by the longest of them, so all fit; the columns' counts are then the profile that the next round aligns
to, in which a column costs a base what share of the reads has something else, and a gap likewise. Gaps and insertions of different reads thus meet in the same columns.
Columns without a base go. A group's reads are never in one task: its profile travels to its sequences, and its counts are
summed before they are exchanged.

Edge cases: a null sequence counts as empty, and is all gaps; letters other than A, C, G and T fit no column and keep their own place; a
group of empty sequences has no columns and rows ''.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .consensus import centres
from .pairwise import CELLS
from .tables import cut, discard

#: What a column costs that no read agrees with, and a base that stands between columns.
FULL = 200
_CODE = np.full(256, 5, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i

_PLACED = T.StructType([T.StructField("row", T.StringType()), T.StructField("more", T.MapType(T.IntegerType(), T.StringType()))])


def place(profiles: list[bytes], texts: list[str]) -> Iterator[tuple[str, dict[int, str]]]:
    """The letter of each text at its profile's columns, and what it has after column pos (-1: before all), at the least cost.

    A profile has five bytes a column, the costs of A, C, G, T and a gap. Of equal ways the walk from the end takes a letter in a
    column first, then a gap, then a letter between columns.
    """
    at = 0
    while at < len(texts):
        most, k = 0, at
        while k < len(texts):
            cells = max(most, (len(profiles[k]) // 5 + 1) * (len(texts[k]) + 1))
            if k > at and cells * (k - at + 1) > CELLS:
                break
            most, k = cells, k + 1
        yield from _place(profiles[at:k], texts[at:k])
        at = k


def _place(profiles: list[bytes], texts: list[str]) -> Iterator[tuple[str, dict[int, str]]]:
    n, m = np.array([len(p) // 5 for p in profiles]), np.array([len(t) for t in texts])
    cost = np.full((len(texts), int(n.max()), 6), FULL, np.int32)
    code = np.full((len(texts), max(1, int(m.max()))), 5, np.int64)
    for k, (p, t) in enumerate(zip(profiles, texts, strict=True)):
        cost[k, : n[k], :5] = np.frombuffer(p, np.uint8).reshape(-1, 5)
        code[k, : m[k]] = _CODE[np.frombuffer(t.encode("ascii", "replace"), np.uint8)]
    step = np.arange(code.shape[1] + 1, dtype=np.int32) * FULL
    d = np.empty((cost.shape[1] + 1, len(texts), code.shape[1] + 1), np.int32)
    d[0] = step
    rows = np.arange(len(texts))
    for i in range(1, len(d)):
        t = d[i - 1] + cost[:, i - 1, 4, None]
        np.minimum(t[:, 1:], d[i - 1][:, :-1] + np.take_along_axis(cost[:, i - 1], code, axis=1), out=t[:, 1:])
        d[i] = np.minimum.accumulate(t - step, axis=1) + step
    i, j = n.copy(), m.copy()
    ops = np.zeros((int((n + m).max()), len(texts)), np.uint8)
    for s in range(len(ops)):
        live = (i > 0) | (j > 0)
        if not live.any():
            break
        here, up, left = d[i, rows, j], np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        both = (i > 0) & (j > 0) & (here == d[up, rows, left] + (cost[rows, up, code[rows, left]] if cost.shape[1] else 0))
        gap = ~both & (i > 0) & (here == d[up, rows, j] + (cost[rows, up, 4] if cost.shape[1] else 0))
        ops[s] = both + 2 * gap + 3 * (live & ~both & ~gap)
        i, j = i - (both | gap), j - (both | (live & ~both & ~gap))
    for k, t in enumerate(texts):
        o = ops[:, k]
        o = o[o > 0][::-1]
        column, letter = np.cumsum(o != 3) - 1, np.cumsum(o != 2) - 1
        raw = np.frombuffer(t.encode("ascii", "replace"), np.uint8)
        row = np.full(n[k], 45, np.uint8)
        row[column[o == 1]] = raw[letter[o == 1]]
        more: dict[int, str] = {}
        for c, x in zip(column[o == 3].tolist(), letter[o == 3].tolist(), strict=True):
            more[c] = more.get(c, "") + t[x]
        yield row.tobytes().decode("ascii"), more


@F.pandas_udf(_PLACED)
def _placed(profile: pd.Series, seq: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(place(profile.tolist(), seq.tolist())), columns=["row", "more"])


def _bytes(codes: Column) -> Column:
    return F.unhex(F.array_join(codes, ""))


def _of_text(seq: Column) -> Column:
    """The profile of a single sequence: another base and a gap cost all, its own nothing."""
    full, own = f"{FULL:02X}", "00"
    one = lambda x: F.element_at(F.create_map(*(v for k, b in enumerate("ACGT") for v in (F.lit(b), F.lit(full * k + own + full * (4 - k))))), x)
    return _bytes(F.transform(F.filter(F.split(F.upper(seq), ""), lambda x: x != ""), lambda x: F.coalesce(one(x), F.lit(full * 5))))


def widths(placed: DataFrame, group: str, length: Column) -> DataFrame:
    """(group, widths): how many columns the frame needs before each of its columns and after the last."""
    more = placed.select(group, F.explode("more").alias("pos", "text")).groupBy(group, "pos").agg(F.max(F.length("text")).alias("width"))
    wide = more.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("pos", "width"))).alias("wide"))
    size = placed.groupBy(group).agg(F.max(length).alias("size"))
    at = F.transform(F.sequence(F.lit(-1), F.col("size") - 1), lambda i: F.coalesce(F.element_at("wide", i), F.lit(0)))
    return size.join(wide, group, "left").select(group, at.alias("widths"))


def widened(row: Column, more: Column, wide: Column) -> Column:
    """A row in the widened frame: what stands between two columns begins at the first column there."""
    slot = lambda w, i: F.concat(F.call_function("rpad", F.coalesce(F.element_at(more, (i - 1).cast("int")), F.lit("")), w, F.lit("-")), F.substring(row, (i + 1).cast("int"), F.lit(1)))
    return F.array_join(F.transform(wide, slot), "")


def profiles(rows: DataFrame, group: str, copies: str, row: str) -> DataFrame:
    """(group, profile): the costs of the columns that have bases."""
    cell = rows.select(group, F.col(copies).alias("n"), F.posexplode(F.split(row, "")).alias("pos", "base")).where("base <> ''")
    n = lambda b: F.sum(F.when(F.col("base") == b, F.col("n")).otherwise(0))
    col = cell.groupBy(group, "pos").agg(*(n(b).alias(f"n{k}") for k, b in enumerate("ACGT-")), F.sum("n").alias("total")).where("n4 < total")
    costs = F.concat(*(F.lpad(F.hex(F.round(FULL * (1 - F.col(f"n{k}") / F.col("total"))).cast("int")), 2, "0") for k in range(5)))
    both = F.array_sort(F.collect_list(F.struct("pos", costs.alias("costs"))))
    return col.groupBy(group).agg(both.alias("x")).select(group, _bytes(F.transform("x", lambda c: c["costs"])).alias("profile"))


def _majority(rows: DataFrame, group: str, copies: str, row: str) -> DataFrame:
    """(group, consensus): the most frequent letter of each column as one text, gaps too; of equals A, C, G, T, then the gap."""
    cell = rows.select(group, F.col(copies).alias("n"), F.posexplode(F.split(row, "")).alias("pos", "base")).where("base <> ''")
    cell = cell.withColumn("base", F.when(F.col("base").isin(*"ACGT"), F.col("base")).otherwise("-"))
    n = cell.groupBy(group, "pos", "base").agg(F.sum("n").alias("n"))
    top = n.groupBy(group, "pos").agg(F.max_by("base", F.struct(F.col("n"), (-F.instr(F.lit("ACGT-"), F.col("base"))).alias("rank"))).alias("base"))
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("consensus"))


def frame(classes: DataFrame, group: str, seq: str, copies: str, rounds: int = 1) -> DataFrame:
    """``classes`` (distinct sequences of a group with their copies) with row_aln, in the group's common columns: aligned to the centre, then to
    the consensus that this gives, then ``rounds`` times to the profile of the columns before."""
    own = cut(classes.withColumn(seq, F.upper(F.coalesce(seq, F.lit("")))).groupBy(group, seq).agg(F.sum(copies).alias(copies)))
    profile = centres(own, group, seq, copies).select(group, _of_text(F.col("centre")).alias("profile"))
    for k in range(rounds + 2):
        # alignment costs more than rows: so many partitions, however small the sequences are
        spread = own.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, seq)
        held = spread.join(profile, group, "left").withColumn("profile", F.coalesce("profile", F.unhex(F.lit(""))))  # a group of empty sequences has none
        x = held.select(group, seq, copies, _placed("profile", seq).alias("x"), (F.length("profile") / 5).cast("int").alias("size"))
        placed = cut(x.select(group, seq, copies, "x.row", "x.more", "size"))
        wide = widths(placed, group, F.col("size"))
        rows = cut(placed.join(wide, group).select(group, seq, copies, widened(F.col("row"), F.col("more"), F.col("widths")).alias("row")))
        if k == 0:
            profile = cut(_majority(rows, group, copies, "row").select(group, _of_text(F.replace("consensus", F.lit("-"), F.lit(""))).alias("profile")))
        elif k <= rounds:
            profile = cut(profiles(rows, group, copies, "row").select(group, "profile"))
        if k <= rounds:
            discard(placed, rows)
    kept = rows.select(group, F.posexplode(F.split("row", "")).alias("pos", "base")).where("base not in ('', '-')").groupBy(group).agg(F.array_sort(F.collect_set("pos")).alias("kept"))
    row = F.array_join(F.transform(F.coalesce("kept", F.array().cast("array<int>")), lambda i: F.substring("row", i + 1, F.lit(1))), "")
    return rows.join(kept, group, "left").select(group, seq, copies, row.alias("row_aln"))


def class_rows(reads: DataFrame, group: str, seq: str, rounds: int = 1) -> DataFrame:
    """(group, seq, copies, row_aln): the distinct sequences of each group in its common columns, with how many reads have them."""
    r = reads.select(group, F.upper(F.coalesce(seq, F.lit(""))).alias("seq"))
    return frame(r.groupBy(group, "seq").agg(F.count("*").alias("copies")), group, "seq", "copies", rounds)


def of_reads(reads: DataFrame, found: DataFrame, group: str, read: str, seq: str) -> DataFrame:
    """(group, read, columns of ``found``): what is known of each distinct (group, seq), for its reads; those of a null group have none."""
    r = reads.select(group, read, F.upper(F.coalesce(seq, F.lit(""))).alias("seq")).where(F.col(group).isNotNull())
    return r.join(found, [group, "seq"]).drop("seq")


def common_columns(reads: DataFrame, group: str, read: str, seq: str, rounds: int = 1) -> DataFrame:
    """(group, read, row_aln): all reads of each group in its common columns."""
    return of_reads(reads, class_rows(reads, group, seq, rounds).drop("copies"), group, read, seq)


def consensus_rows(rows: DataFrame, group: str, row: str = "row_aln", copies: str | None = None) -> DataFrame:
    """(group, consensus): the most frequent letter of each column as one text, gaps too."""
    n = F.col(copies) if copies else F.lit(1)
    return _majority(rows.select(group, F.col(row).alias("row"), n.alias("copies")), group, "copies", "row")


def run_context(consensus: DataFrame, group: str, least: int = 1) -> DataFrame:
    """``consensus`` with context: a text of the same columns with the base of the run of ``least`` or more that a column belongs to, a dot where
    there's none. Gap columns within and beside a run belong to it; between two runs of different bases they are dealt from both
    ends, and the middle one of an odd number has none."""
    from .columns import run_columns

    c = run_columns(consensus, group, "consensus", least)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("context", F.lit(".")).alias("c")))), lambda x: x["c"]), "")
    return consensus.join(c.groupBy(group).agg(text.alias("context")), group, "left").withColumn("context", F.coalesce("context", F.lit("")))


def scored(rows: DataFrame, consensus: DataFrame, group: str, row: str = "row_aln") -> DataFrame:
    """``rows`` with how each differs from (group, consensus, context): score has a letter a column, | for the same, = for a base more or less in a run, a
    blank for an error; edits, insertions, deletions and substitutions count all, normalised only errors that no run explains; rid is the identity by
    them. ``normal`` is the row with the consensus' letter where a run explains the difference. All stays in one row: nothing is exploded."""
    x = rows.join(consensus.select(group, "consensus", "context"), group)
    letters = F.arrays_zip(F.split(F.upper(row), "").alias("r"), F.split("consensus", "").alias("c"), F.split("context", "").alias("h"))
    kind = lambda z: F.when(z["r"] == z["c"], "|").when(((z["r"] == "-") & (z["c"] == z["h"])) | ((z["c"] == "-") & (z["r"] == z["h"])), F.lit("=")).otherwise(" ")
    x = x.withColumn("z", F.when(F.length(row) > 0, letters).otherwise(F.array().cast(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in "rch"])))))
    n = lambda cond: F.size(F.filter("z", cond))
    x = x.withColumn("score", F.array_join(F.transform("z", kind), ""))
    x = x.withColumn("normal", F.array_join(F.transform("z", lambda z: F.when(kind(z) == "=", z["c"]).otherwise(z["r"])), ""))
    x = x.withColumn("insertions", n(lambda z: (z["r"] != "-") & (z["c"] == "-"))).withColumn("deletions", n(lambda z: (z["r"] == "-") & (z["c"] != "-"))).withColumn("substitutions", n(lambda z: (z["r"] != "-") & (z["c"] != "-") & (z["r"] != z["c"])))
    x = x.withColumn("edits", F.col("insertions") + F.col("deletions") + F.col("substitutions")).withColumn("normalised", F.length("score") - F.length(F.replace("score", F.lit(" "), F.lit(""))))
    bases = F.length(F.replace("consensus", F.lit("-"), F.lit("")))
    return x.withColumn("rid", F.when(bases > 0, 1 - F.col("normalised") / bases)).select(*rows.columns, "score", "normal", "edits", "insertions", "deletions", "substitutions", "normalised", "rid")
