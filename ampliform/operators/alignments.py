"""Positional operators over aligned rows. A row is (group, read, aligned text); cells are its characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import base_mask, mask_code

#: The order in which equal counts are ranked.
ALLELES = ("A", "C", "G", "T", "-")


def allele_rank(base: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ALLELES)), base)


def cells(rows: DataFrame, group: str, read: str, aligned: str) -> DataFrame:
    """(group, read, pos, base): one row per character, from 0; anything but A, C, G and T is a gap."""
    c = rows.select(group, read, F.posexplode(F.split(F.upper(aligned), "")).alias("pos", "base")).where("base <> ''")
    return c.withColumn("base", F.when(F.col("base").isin("A", "C", "G", "T"), F.col("base")).otherwise("-"))


def cells_at(rows: DataFrame, positions: DataFrame, group: str, read: str, aligned: str) -> DataFrame:
    """The `cells` at (group, pos) alone. A group's positions travel to its rows as one array, so no row becomes all its cells."""
    at = positions.groupBy(group).agg(F.collect_set("pos").alias("at"))
    r = rows.select(group, read, F.upper(aligned).alias("row")).join(at, group).select(group, read, "row", F.explode("at").alias("pos"))
    c = r.select(group, read, "pos", F.substring("row", F.col("pos") + 1, F.lit(1)).alias("base")).where("base <> ''")
    return c.withColumn("base", F.when(F.col("base").isin("A", "C", "G", "T"), F.col("base")).otherwise("-"))


def composition(rows: DataFrame, group: str, read: str, aligned: str, copies: str | None = None) -> DataFrame:
    """(group, pos, base, n). Counts are summed before they are exchanged: a group's columns bound the rows. With ``copies``, a row counts
    as often as that."""
    if copies:
        return cells(rows, group, copies, aligned).groupBy(group, "pos", "base").agg(F.sum(copies).alias("n"))
    return cells(rows, group, read, aligned).groupBy(group, "pos", "base").agg(F.count("*").alias("n"))


def together(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` with those of a group in one partition, for many small groups: a row is exchanged whole, where its cells, of which a small
    group has few alike, would be a hundred rows. Cells take more than rows, so partitions stay as many as the session has."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), group)


def consensus_cells(comp: DataFrame, group: str) -> DataFrame:
    """(group, pos, base, n, total): the most frequent allele of each column."""
    by = Window.partitionBy(group, "pos")
    top = comp.withColumn("total", F.sum("n").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), allele_rank(F.col("base")))))
    return top.where("r = 1").drop("r")


def variant_columns(comp: DataFrame, group: str, frequency: float, count: int) -> DataFrame:
    """(group, pos, alleles, n_variants): columns where an allele besides the first passes both floors."""
    by = Window.partitionBy(group, "pos")
    ranked = comp.withColumn("total", F.sum("n").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), allele_rank(F.col("base")))))
    passing = ranked.where((F.col("r") > 1) & (F.col("n") >= count) & (F.col("n") >= F.col("total") * F.lit(frequency)))
    return passing.groupBy(group, "pos").agg(F.array_join(F.array_sort(F.collect_list("base")), "").alias("alleles"), F.count("*").alias("n_variants"))


def without_majority(comp: DataFrame, group: str) -> DataFrame:
    """(group, pos, top, total): columns whose first base has at most half of two or more bases."""
    bases = comp.where("base <> '-'").groupBy(group, "pos").agg(F.max("n").alias("top"), F.sum("n").alias("total"))
    return bases.where("total >= 2 and top * 2 <= total")


def ambiguous_consensus(comp: DataFrame, group: str, frequency: float, count: int) -> DataFrame:
    """(group, consensus, n_ambiguous): the majority text, with codes where a second base passes both floors or none has a majority."""
    by = Window.partitionBy(group, "pos")
    c = comp.withColumn("total", F.sum("n").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), allele_rank(F.col("base")))))
    c = c.withColumn("bases", F.sum(F.when(F.col("base") != "-", F.col("n"))).over(by)).withColumn("top", F.max(F.when(F.col("base") != "-", F.col("n"))).over(by))
    passing = (F.col("n") >= count) & (F.col("n") >= F.col("total") * F.lit(frequency))
    tied = (F.col("bases") >= 2) & (F.col("top") * 2 <= F.col("bases"))
    mask = F.when((F.col("r") == 1) | (F.col("base") != "-") & (passing | tied), base_mask(F.col("base"))).otherwise(0)
    col = c.groupBy(group, "pos").agg(F.bit_or(mask).alias("mask"), F.max(F.when(F.col("r") == 1, F.col("base"))).alias("first"))
    col = col.where("first <> '-'").withColumn("code", mask_code(F.col("mask")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "")
    return col.groupBy(group).agg(text.alias("consensus"), F.count_if(~F.col("code").isin("A", "C", "G", "T")).alias("n_ambiguous"))


def weighted_consensus(rows: DataFrame, group: str, read: str, aligned: str, weight: str, fraction: float = 0.5, floor: int = 3) -> DataFrame:
    """(group, consensus, snp_count): each row votes with its weight; a column stays if its bases have ``fraction`` of the weight
    and ``floor`` at least, and several bases give a code."""
    c = rows.select(group, F.col(weight).alias("w"), F.posexplode(F.split(F.upper(aligned), "")).alias("pos", "base")).where("base <> ''")
    c = c.withColumn("base", F.when(F.col("base").isin("A", "C", "G", "T"), F.col("base")).otherwise("-"))
    col = c.groupBy(group, "pos").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("base") != "-", F.col("w")).otherwise(0)).alias("bases"), F.bit_or(base_mask(F.col("base"))).alias("mask"))
    kept = col.where((F.col("bases") >= F.col("all") * F.lit(fraction)) & (F.col("bases") >= floor)).withColumn("code", mask_code(F.col("mask")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "")
    return kept.groupBy(group).agg(text.alias("consensus"), F.count_if(~F.col("code").isin("A", "C", "G", "T")).alias("snp_count"))


def read_identities(rows: DataFrame, comp: DataFrame, group: str, read: str, aligned: str) -> DataFrame:
    """(group, read, rid): 1 - columns that differ from the consensus / bases of the consensus. A group's consensus is one text, which
    meets each row whole."""
    cons = consensus_cells(comp, group).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("c_row"))
    row = F.regexp_replace(F.upper(aligned), "[^ACGT]", "-")
    r = rows.select(group, read, row.alias("row")).join(cons, group)
    errors = F.size(F.filter(F.zip_with(F.split("row", ""), F.split("c_row", ""), lambda x, y: x != y), lambda x: x))
    return r.select(group, read, (1 - errors / F.length(F.replace("c_row", F.lit("-"), F.lit("")))).alias("rid"))


def identity_outliers(rids: DataFrame, group: str, z: float = 1.5, gap: float = 2.5, least_mad: float = 0.002, drop: float = 0.02) -> DataFrame:
    """``rids`` with outlier: far below the median in units of the median deviation, or the worst one beyond a gap, and at
    least ``drop`` below the median; groups of two or fewer have none. The second worst comes from sums, so no group is sorted."""
    mid = rids.groupBy(group).agg(F.median("rid").alias("median"), F.count("*").alias("members"), F.min("rid").alias("worst"), F.max("rid").alias("best"))
    d = rids.join(mid, group)
    off = F.abs(F.col("rid") - F.col("median"))
    more = d.groupBy(group).agg(F.median(off).alias("mad"), F.count_if(F.col("rid") == F.col("worst")).alias("ties"), F.min(F.when(F.col("rid") > F.col("worst"), F.col("rid"))).alias("above"))
    d = d.join(more, group)
    second = F.when(F.col("ties") > 1, F.col("worst")).otherwise(F.col("above"))
    far = F.lit(0.6745) * (F.col("rid") - F.col("median")) / F.greatest(F.col("mad"), F.lit(least_mad)) < -z
    rest, apart = F.col("best") - second, second - F.col("worst")
    alone = (F.col("rid") == F.col("worst")) & F.when(rest > 1e-9, apart > gap * rest).otherwise(apart > 5 * least_mad)
    low = F.col("median") - F.col("rid") >= drop
    return d.select(*rids.columns, ((F.col("members") >= 3) & low & (far | F.coalesce(alone, F.lit(False)))).alias("outlier"))


def with_errors(reads: DataFrame, read: str, seq: str, rate: int) -> DataFrame:
    """(read, seq) with errors in ``rate`` of 256 bases: a base goes, gets another after it, or becomes another, as the digest of
    the read's name and the place decides."""

    def one(base: Column, i: Column) -> Column:
        h = F.md5(F.concat(F.col(read).cast("string"), F.lit(":"), (i + 1).cast("string")))
        x, kind = F.conv(F.substring(h, 1, 2), 16, 10).cast("int"), F.conv(F.substring(h, 3, 1), 16, 10).cast("int") % 3
        more = F.concat(base, F.substring(F.lit("ACGT"), x % 4 + 1, F.lit(1)))
        return F.when(x >= rate, base).when(kind == 0, "").when(kind == 1, more).otherwise(F.translate(base, "ACGT", "CGTA"))

    return reads.select(read, F.array_join(F.transform(F.split(seq, ""), one), "").alias("seq"))


def haplotypes(c: DataFrame, positions: DataFrame, group: str, read: str, count: int, frequency: float) -> DataFrame:
    """(group, pos, allele, members): alleles at the given columns that pass both floors of their group's reads."""
    at = c.join(positions.select(F.col(group).alias("p_group"), F.col("pos").alias("p_pos")), (F.col(group) == F.col("p_group")) & (F.col("pos") == F.col("p_pos")))
    n = at.groupBy(group, "pos", F.col("base").alias("allele")).agg(F.count("*").alias("members"))
    by = Window.partitionBy(group, "pos")
    return n.withColumn("total", F.sum("members").over(by)).where((F.col("members") >= count) & (F.col("members") >= F.col("total") * F.lit(frequency))).drop("total")


def phasing_errors(c: DataFrame, positions: DataFrame, group: str, read: str, count: int, frequency: float) -> DataFrame:
    """(group, pos, error): how mixed the other variant columns stay when reads are split at this one; needs two alleles that pass."""
    p = positions.select(F.col(group).alias("p_group"), F.col("pos").alias("p_pos"))
    at = c.join(p, (F.col(group) == F.col("p_group")) & (F.col("pos") == F.col("p_pos"))).select(group, read, "pos", "base")
    good = haplotypes(c, positions, group, read, count, frequency)
    several = good.groupBy(group, "pos").agg(F.count("*").alias("k")).where("k >= 2").select(group, "pos")
    split = at.join(good.join(several, [group, "pos"]).select(group, "pos", F.col("allele").alias("base"), "members"), [group, "pos", "base"])
    split = split.select(group, read, F.col("pos").alias("by"), F.col("base").alias("allele"), "members")
    inner = split.join(at.hint("merge"), [group, read]).groupBy(group, "by", "allele", "members", "pos", "base").agg(F.count("*").alias("n"))
    minor = inner.groupBy(group, "by", "allele", "members", "pos").agg((1 - F.max("n") / F.sum("n")).alias("e"))
    per = minor.groupBy(group, "by", "allele", "members").agg(F.avg("e").alias("e"))
    return per.groupBy(group, F.col("by").alias("pos")).agg((F.sum(F.col("e") * F.col("members")) / F.sum("members")).alias("error"))


def expected_error(rows: DataFrame, comp: DataFrame, rates: dict[str, float], group: str) -> DataFrame:
    """(group, observed, expected, columns, err_factor): mismatch shares of the consensus' columns over what the run lengths lead one to expect."""
    cons = consensus_cells(comp, group).where("base <> '-'")
    obs = comp.join(cons.select(F.col(group).alias("c_group"), F.col("pos").alias("c_pos"), F.col("base").alias("c_base")), (F.col(group) == F.col("c_group")) & (F.col("pos") == F.col("c_pos")))
    per = obs.groupBy(group, "pos").agg((F.sum(F.when(F.col("base") != F.col("c_base"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    by = Window.partitionBy(group).orderBy("pos")
    isle = cons.withColumn("new", (F.col("base") != F.coalesce(F.lag("base").over(by), F.lit(""))).cast("int")).withColumn("run", F.sum("new").over(by))
    size = isle.withColumn("length", F.count("*").over(Window.partitionBy(group, "run"))).select(group, "pos", "length")
    rate = F.when(F.col("length") == 1, rates["non-hp-sub"] + rates["non-hp-indel"])
    for k in range(2, 6):
        rate = rate.when(F.col("length") == k, rates[f"hp-l{k}"])
    rate = rate.otherwise(1.5 * rates["hp-l5"])
    out = per.join(size, [group, "pos"]).groupBy(group).agg(F.sum("share").alias("observed"), F.sum(rate).alias("expected"), F.count("*").alias("columns"))
    return out.withColumn("err_factor", F.col("observed") / F.col("expected"))
