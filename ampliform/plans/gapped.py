"""Queries from reads that are not aligned yet to columns, consensus, variants and error rates, with SQL from the planted columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignments, columns, frames, phasing, reassignment, runs
from ..operators.tables import cut
from .derived import gapped_oracle, load
from .queries import query


def _classes(spark, d):
    """The distinct gapped reads in common columns; aligned once for the queries of an application over the same tables."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _ALIGNED:
        _ALIGNED[key] = cut(frames.class_rows(load(spark, d, "gapped"), "specimen", "seq"))
    return _ALIGNED[key]


_ALIGNED: dict = {}


def _of_reads(spark, d, found):
    return frames.of_reads(load(spark, d, "gapped"), found, "specimen", "read_id", "seq")


def _rows(spark, d):
    return _of_reads(spark, d, _classes(spark, d).drop("copies"))


def _comp(spark, d):
    return alignments.composition(_classes(spark, d), "specimen", "seq", "row_aln", "copies")


_TOP = "gtop as (select specimen, pos, base as c from (select *, row_number() over (partition by specimen, pos order by n desc, instr('ACGT-', base)) as r from gcomp) where r = 1)"


@query(gapped_oracle("select specimen, pos, base, n from gcomp"))
def gapped_composition(spark, d):
    return _comp(spark, d)


@query(gapped_oracle("select read_id, string_agg(base, '' order by pos) as row_aln from gcells group by read_id"))
def gapped_rows(spark, d):
    return _rows(spark, d).select("read_id", "row_aln")


@query(gapped_oracle("select specimen, string_agg(c, '' order by pos) as consensus from gtop group by specimen", _TOP))
def gapped_consensus(spark, d):
    return frames.consensus_rows(_classes(spark, d), "specimen", copies="copies")


@query(gapped_oracle("""select specimen, pos, string_agg(base, '' order by base) as alleles, count(*) as n_variants from (select *, sum(n) over (partition by specimen, pos) as total, row_number() over (partition by specimen, pos order by n desc, instr('ACGT-', base)) as r from gcomp)
    where r > 1 and n >= 3 and n >= total * 0.05 group by specimen, pos"""))  # fmt: skip
def gapped_variants(spark, d):
    return alignments.variant_columns(_comp(spark, d), "specimen", 0.05, 3)


@query(gapped_oracle("""select read_id, count_if(base <> '-' and c = '-')::int as insertions, count_if(base = '-' and c <> '-')::int as deletions, count_if(base <> '-' and c <> '-' and base <> c)::int as substitutions,
    count_if(base <> c)::int as normalised, round(1 - count_if(base <> c) / count_if(c <> '-')::double, 9) as rid from gcells join gtop using (specimen, pos) group by read_id""", _TOP))  # fmt: skip
def gapped_scores(spark, d):
    rows = _classes(spark, d)
    s = frames.scored(rows, frames.run_context(frames.consensus_rows(rows, "specimen", copies="copies"), "specimen", 6), "specimen")
    return _of_reads(spark, d, s).select("read_id", "insertions", "deletions", "substitutions", "normalised", F.round("rid", 9).alias("rid"))


@query(gapped_oracle("""select specimen, count_if(base = c and c <> '-')::bigint as matches, count_if(c <> '-' and base not in (c, '-'))::bigint as subs, count_if(c <> '-' and base = '-')::bigint as dels, count_if(c = '-' and base <> '-')::bigint as ins, count(distinct read_id) as reads
    from gcells join gtop using (specimen, pos) group by specimen""", _TOP))  # fmt: skip
def gapped_errors(spark, d):
    return runs.other_errors(_rows(spark, d), "specimen", "read_id", "row_aln")


@query(gapped_oracle("select specimen, pos, sum(n)::bigint as coverage, sum(case when base not in ('-', c) and c <> '-' then n else 0 end)::bigint as subs, sum(case when base <> '-' and c = '-' then n else 0 end)::bigint as ins, sum(case when base = '-' and c <> '-' then n else 0 end)::bigint as dels from gcomp join gtop using (specimen, pos) group by all", _TOP))
def gapped_statistics(spark, d):
    comp = _comp(spark, d)
    return columns.column_statistics(comp, alignments.consensus_cells(comp, "specimen"), "specimen").select("specimen", "pos", "coverage", "subs", "ins", "dels")


@query(gapped_oracle("""select specimen, round(sum(share), 9) as observed, round(count(*) * 0.0066, 9) as expected, count(*) as columns from (
      select specimen, pos, sum(case when base <> c then n else 0 end) / sum(n)::double as share from gcomp join gtop using (specimen, pos) where c <> '-' group by all) group by specimen""", _TOP))  # fmt: skip
def gapped_error_factor(spark, d):
    rates = {"non-hp-sub": 0.0039, "non-hp-indel": 0.0027} | {f"hp-l{k}": 0.01 * k for k in range(2, 6)}
    e = alignments.expected_error(None, _comp(spark, d), rates, "specimen")
    return e.select("specimen", F.round("observed", 9).alias("observed"), F.round("expected", 9).alias("expected"), "columns")


def _splits(n: str, m: str) -> str:
    return f"({n}) >= 8 and {m} >= 4 and {m} >= 0.08 * ({n}) and ({n}) - {m} >= 4 and ({n}) - {m} >= 0.08 * ({n})"


#: Two sites: the one with more of its rarer allele leaves less behind; the larger part may split at the other.
@query(gapped_oracle(f"""select read_id, case when one and (n1 >= n2 or not two) then case when hap = 1 then a when {_splits("n - n1", "n2")} then concat(a, '-', b) else a end
                             when two then case when hap = 2 then b when {_splits("n - n2", "n1")} then concat(b, '-', a) else b end else '' end as path
    from (select read_id, specimen, hap, substr(s1, 20, 1) as a, substr(s1, 70, 1) as b from planted) join (select *, {_splits("n", "n1")} as one, {_splits("n", "n2")} as two
      from (select specimen, count(*) as n, count_if(hap = 1) as n1, count_if(hap = 2) as n2 from planted group by specimen)) using (specimen)"""))  # fmt: skip
def phased_reads(spark, d):
    return phasing.phased(load(spark, d, "gapped"), "specimen", "read_id", "seq", 4, 0.08)[0].select("read_id", "path")


_MOVED = """two as (select *, hap = 1 and read_id % 7 = 0 as moved from planted where hap < 2),
      steady as (select specimen from two group by specimen having count_if(hap = 1 and not moved) >= 5 and count_if(hap = 0) >= 8)"""


def _two(spark, d):
    r = load(spark, d, "gapped").where("hap < 2").withColumn("cluster", F.when((F.col("hap") == 1) & (F.col("read_id") % 7 == 0), 0).otherwise(F.col("hap")))
    n = r.groupBy("specimen").agg(F.count_if((F.col("hap") == 1) & (F.col("cluster") == 1)).alias("a"), F.count_if(F.col("hap") == 0).alias("b")).where("a >= 5 and b >= 8")
    return r.join(n.select("specimen"), "specimen")


@query(gapped_oracle("select read_id, hap as cluster from two join steady using (specimen)", _MOVED))
def reads_by_agreement(spark, d):
    return reassignment.reassigned(_two(spark, d), "specimen", "cluster", "read_id", "seq").select("read_id", "cluster")


@query(gapped_oracle("select read_id, hap as cluster from planted where hap < 2 and read_id % 9 = 0"))
def recovered_reads(spark, d):
    r = load(spark, d, "gapped").where("hap < 2")
    turned = F.concat(F.substring("tpl", 1, 19), F.translate(F.substring("tpl", 20, 1), "ACGT", "CATG"), F.substring("tpl", 21, 96))
    c = r.select("specimen", "tpl").distinct().select("specimen", F.lit(1).alias("grp"), F.explode(F.array(F.struct(F.lit(0).alias("cluster"), F.col("tpl").alias("consensus")), F.struct(F.lit(1).alias("cluster"), turned.alias("consensus")))).alias("c")).select("specimen", "grp", "c.*")
    return reassignment.recovered(r.where("read_id % 9 = 0"), c, "specimen", "grp", "cluster", "read_id", "seq", 0.9).select("read_id", "cluster")
