"""More registered queries: columns of small alignments, splits, fitting, curation and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records, sequence
from ..operators import alignments, columns, consensus, curation, fitting, graph, pairwise, runs
from .derived import CELLS, load, oracle
from .queries import _RANKED, _RID, _RUNS, _VARIANT, RATES, _at, _ids, query

# ---- columns of small alignments

_COLUMNS = """dc as (select donor, i - 1 as pos, substr(row_aln, i, 1) as base from msa, (select unnest(range(1, 97)) as i)),
      col as (select donor, pos, count_if(base = '-')::bigint as gaps, count(distinct case when base <> '-' then base end)::bigint as kinds, max(case when base <> '-' then base end) as base from dc group by all),
      near as (select *, lag(case when gaps = 0 and kinds = 1 then base end) over (partition by donor order by pos) as l, lead(case when gaps = 0 and kinds = 1 then base end) over (partition by donor order by pos) as r from col),
      isles as (select *, pos - row_number() over (partition by donor order by pos) as isle from near where gaps > 0 and kinds > 0),
      raw as (select donor, min(pos)::bigint as start, max(pos)::bigint as stop, max(base) as base, max(kinds) = 1 and count(distinct base) = 1 and (coalesce(arg_min(l, pos) = max(base), false) or coalesce(arg_max(r, pos) = max(base), false)) as h
              from (select donor, isle, pos, base, kinds, coalesce(l, '?') as l, coalesce(r, '?') as r from isles) group by donor, isle),
      near_run as (select raw.*, regexp_extract(substr(row_aln, 1, start), '[-' || base || ']*$') || substr(row_aln, start + 1, stop - start + 1) || regexp_extract(substr(row_aln, stop + 2), '^[-' || base || ']*') as near from raw join msa using (donor)),
      events as (select donor, start, stop, base, h and min(length(near) - length(replace(near, base, ''))) >= 2 as homopolymer from near_run group by donor, start, stop, base, h)"""


def _donor_columns(spark, d):
    rows = alignments.together(load(spark, d, "msa").select("donor", "read_id", "row_aln"), "donor")
    return rows, columns.column_counts(alignments.composition(rows, "donor", "read_id", "row_aln"), "donor")


@query(oracle("select * from events", _COLUMNS))
def indel_events(spark, d):
    rows, c = _donor_columns(spark, d)
    e = columns.indel_events(c, "donor", rows, "row_aln", 2)
    return e.withColumn("start", F.col("start").cast("long")).withColumn("stop", F.col("stop").cast("long"))


@query(oracle("""select donor, snps, coalesce(structural, 0) as structural, coalesce(structural_length, 0) as structural_length, coalesce(hs, 0) as homopolymer, coalesce(homopolymer_length, 0) as homopolymer_length
    from (select donor, count_if(kinds > 1 and gaps = 0)::bigint as snps from col group by donor) left join (
      select donor, count_if(not homopolymer)::bigint as structural, max(case when not homopolymer then stop - start + 1 end) as structural_length, count_if(homopolymer)::bigint as hs, max(case when homopolymer then stop - start + 1 end) as homopolymer_length
      from events group by donor) using (donor)""", _COLUMNS))  # fmt: skip
def column_summary(spark, d):
    rows, c = _donor_columns(spark, d)
    return columns.column_summary(c, columns.indel_events(c, "donor", rows, "row_aln", 2), "donor")


#: Rows of different extent: of each three reads one begins late and one ends early.
_EXTENTS = "parts as (select donor, read_id, price % 9 + 1 as w, case read_id % 3 when 0 then concat(substr(row_aln, 1, 60), repeat('-', 36)) when 1 then concat(repeat('-', 36), substr(row_aln, 37)) else row_aln end as row_aln from msa)"
_SPANS = """sp as (select *, length(row_aln) - length(ltrim(row_aln, '-')) as first, length(rtrim(row_aln, '-')) - 1 as last from parts),
      spans as (select *, max(first) over (partition by donor) as lo, min(last) over (partition by donor) as hi from sp),
      pc as (select donor, w, first, last, lo, hi, i - 1 as pos, substr(row_aln, i, 1) as base from spans, (select unnest(range(1, 97)) as i))"""


def _extents(spark, d):
    r = load(spark, d, "msa")
    a = F.col("row_aln")
    row = F.when(F.col("read_id") % 3 == 0, F.concat(F.substring(a, 1, 60), F.repeat(F.lit("-"), F.lit(36)))).when(F.col("read_id") % 3 == 1, F.concat(F.repeat(F.lit("-"), F.lit(36)), F.substring(a, 37, 96))).otherwise(a)
    return r.select("donor", "read_id", (F.col("price") % 9 + 1).alias("w"), row.alias("row_aln"))


@query(oracle("""select donor, coalesce(overlap, 0) as overlap, (any_lo - least)::int as prefix, (most - any_hi)::int as suffix, coalesce(snps, 0) as snps
    from (select donor, max(lo) as any_lo, max(hi) as any_hi, min(first) as least, max(last) as most from spans group by donor) left join (
      select donor, count_if(gaps = 0)::bigint as overlap, count_if(gaps = 0 and kinds > 1)::bigint as snps from (select donor, pos, count_if(base = '-') as gaps, count(distinct base) as kinds from pc where pos between lo and hi group by all) group by donor) using (donor)""", _EXTENTS, _SPANS))  # fmt: skip
def overlap_summary(spark, d):
    return columns.overlap_summary(_extents(spark, d), "donor", "row_aln")


_MASKED = "case base when 'A' then 1 when 'C' then 2 when 'G' then 4 when 'T' then 8 else 0 end"


@query(oracle(f"""select donor, string_agg(substr('ACMGRSVTWYHKDBN', mask, 1), '' order by pos) as consensus, count_if(mask not in (1, 2, 4, 8))::bigint as snp_count from (
    select donor, pos, bit_or({_MASKED})::int as mask, sum(w) as everything, sum(case when base <> '-' then w else 0 end) as bases, max(lo) as lo, max(hi) as hi from pc where pos between first and last group by donor, pos)
    where mask > 0 and (pos not between lo and hi or bases >= everything * 0.5 and bases >= 3) group by donor""", _EXTENTS, _SPANS))  # fmt: skip
def overlap_consensus(spark, d):
    return columns.overlap_consensus(_extents(spark, d), "donor", "row_aln", "w")


@query(oracle(f"""select specimen, string_agg(substr('ACMGRSVTWYHKDBN', mask, 1), '' order by pos) as consensus, count_if(mask not in (1, 2, 4, 8))::bigint as snp_count from (
    select specimen, pos, case when bit_or(m) = 0 then max(case when first then raw end) else bit_or(m) end::int as mask from (
      select specimen, pos, {_MASKED} as raw, case when n >= bases * 0.2 then {_MASKED} else 0 end as m, row_number() over (partition by specimen, pos order by n desc, instr('ACGT', base)) = 1 as first
      from (select *, sum(n) over (partition by specimen, pos) as everything, sum(case when base <> '-' then n else 0 end) over (partition by specimen, pos) as bases from comp) where base <> '-' and bases >= everything * 0.5 and bases >= 3)
    group by specimen, pos) group by specimen""", CELLS))  # fmt: skip
def read_consensus(spark, d):
    return columns.read_consensus(alignments.composition(load(spark, d, "msa"), "specimen", "read_id", "row_aln"), "specimen", 0.2)


_ROWCOLS = """rc as (select read_id, i - 1 as pos, substr(row_aln, i, 1) as base from msa, (select unnest(range(1, 97)) as i)),
      rb as (select *, base <> '-' and base is distinct from last_value(case when base <> '-' then base end ignore nulls) over (partition by read_id order by pos rows between unbounded preceding and 1 preceding) as new from rc),
      rr as (select *, sum(new::int) over (partition by read_id order by pos) as run from rb),
      rx as (select *, max(case when base <> '-' then base end) over w as run_base, min(case when base <> '-' then pos end) over w as run_start, max(case when base <> '-' then pos end) over w as run_stop, sum((base <> '-')::int) over w as run_length from rr window w as (partition by read_id, run))"""


@query(oracle("""select read_id, run_base, run_start::bigint as run_start, run_length::bigint as run_length, a::bigint as "left", b::bigint as "right" from (
    select *, coalesce(lag(run_stop) over (partition by read_id order by run_start), -1) as a, coalesce(lead(run_start) over (partition by read_id order by run_start), 96) as b
    from (select distinct read_id, run_base, run_start, run_stop, run_length from rx where base <> '-')) where run_length >= 3""", _ROWCOLS))  # fmt: skip
def run_anchors(spark, d):
    r = columns.anchors_of_rows(load(spark, d, "msa"), "read_id", "row_aln", 96, 3)
    return r.select("read_id", "run_base", *(F.col(x).cast("long").alias(x) for x in ("run_start", "run_length", "left", "right")))


@query(oracle("""select read_id, pos::bigint as pos, coalesce(place, -1)::bigint as place, case when base <> '-' or pos < run_stop then tag when tag is not null and nxt is not null then case when solid_next then null else tag end else coalesce(tag, nxt) end as context from (
    select *, case when base <> '-' then sum((base <> '-')::int) over (partition by read_id order by pos) - 1 end as place, case when run_length >= 2 then run_base end as tag, lead(base <> '-') over (partition by read_id order by pos) as solid_next,
      nullif(first_value(case when base <> '-' then case when run_length >= 2 then run_base else '' end end ignore nulls) over (partition by read_id order by pos rows between 1 following and unbounded following), '') as nxt from rx)
    where base = '-' or run_length >= 4""", _ROWCOLS))  # fmt: skip
def run_context_columns(spark, d):
    c = columns.run_columns(load(spark, d, "msa"), "read_id", "row_aln", 2, shown=4)
    return c.where("base = '-' or run_length >= 4").select("read_id", F.col("pos").cast("long").alias("pos"), F.coalesce("place", F.lit(-1)).alias("place"), "context")


@query(oracle("""select specimen, pos, everything as coverage, subs, dels, round((subs + dels) / everything::double, 9) as rate from (
    select comp.specimen, comp.pos, sum(n)::bigint as everything, sum(case when base <> '-' and base <> c then n else 0 end)::bigint as subs, sum(case when base = '-' and length < 2 then n else 0 end)::bigint as dels
    from comp join cruns on comp.specimen = cruns.specimen and comp.pos = cruns.pos join c on c.specimen = comp.specimen and c.pos = comp.pos group by all)""", CELLS, _RID, _RUNS))  # fmt: skip
def column_statistics(spark, d):
    s = _statistics(spark, d)
    return s.select("specimen", F.col("pos").cast("long").alias("pos"), "coverage", "subs", "dels", F.round("rate", 9).alias("rate"))


def _statistics(spark, d):
    rows = load(spark, d, "msa")
    comp = alignments.composition(rows, "specimen", "read_id", "row_aln")
    cons = alignments.consensus_cells(comp, "specimen").where("base <> '-'")
    context = runs.consensus_runs(rows, "specimen", "read_id", "row_aln").where("length >= 2").select("specimen", "pos", F.col("base").alias("context"))
    return columns.column_statistics(comp, cons, "specimen", context)


@query(oracle("""select specimen, pos, string_agg(base, '' order by base) as alleles, count(*) as n_variants from (
    select *, sum(n) over (partition by specimen, pos) as everything, row_number() over (partition by specimen, pos order by n desc, instr('ACGT-', base)) as r
    from (select comp.specimen, comp.pos, base, n, length from comp join cruns on comp.specimen = cruns.specimen and comp.pos = cruns.pos) where not (base = '-' and length >= 2))
    where r > 1 and n >= 3 and n >= everything * 0.1 group by specimen, pos""", CELLS, _RID, _RUNS))  # fmt: skip
def effective_variant_columns(spark, d):
    comp = columns.effective(_statistics(spark, d), "specimen")
    return alignments.variant_columns(comp, "specimen", 0.1, 3).withColumn("pos", F.col("pos").cast("long"))


@query(oracle("""select specimen, kind, base, count(*) as n, count(distinct pos) as columns from (select cells.specimen, pos, base, case when base = '-' then 'del' else 'sub' end as kind
    from cells join c using (specimen, pos) where base <> c and c <> '-') group by all""", CELLS, _RID))  # fmt: skip
def read_error_kinds(spark, d):
    rows = load(spark, d, "msa")
    cons = alignments.consensus_cells(alignments.composition(rows, "specimen", "read_id", "row_aln"), "specimen").where("base <> '-'")
    e = columns.read_errors(rows, cons, "specimen", "read_id", "row_aln")
    return e.groupBy("specimen", "kind", "base").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("columns"))


# ---- splits


@query(oracle("select specimen, alleles, count(*) as members from (select specimen, read_id, string_agg(base, '' order by pos) as alleles from sites group by all) group by all", CELLS, _VARIANT))
def position_tuples(spark, d):
    _, pos = _at(spark, d)
    return columns.position_tuples(load(spark, d, "msa"), pos, "specimen", "read_id", "row_aln")


@query(oracle("""select specimen, pos, error from (select *, row_number() over (partition by specimen order by error, pos) as r from (select specimen, k_pos as pos, round(sum(e * members) / sum(members), 6) as error from (select specimen, k_pos, allele, members, avg(e) as e from (
      select specimen, k_pos, allele, members, pos, 1 - max(n) / sum(n)::double as e from (select s.specimen, s.pos as k_pos, s.base as allele, g.members, o.pos, o.base, count(*) as n
        from sites s join g on g.specimen = s.specimen and g.pos = s.pos and g.base = s.base join (select specimen, pos from g group by all having count(*) >= 2) k on k.specimen = s.specimen and k.pos = s.pos
        join sites o on o.specimen = s.specimen and o.read_id = s.read_id group by all) group by all) group by all) group by all)) where r = 1""",
    CELLS, _VARIANT, "g as (select specimen, pos, base, n as members from (select specimen, pos, base, n, sum(n) over (partition by specimen, pos) as total from (select specimen, pos, base, count(*) as n from sites group by all)) where n >= 3 and n >= total * 0.05)"))
def best_splits(spark, d):
    c, pos = _at(spark, d)
    e = alignments.phasing_errors(c, pos, "specimen", "read_id", 3, 0.05).withColumn("error", F.round("error", 6))
    return columns.best_split(e, "specimen").withColumn("pos", F.col("pos").cast("long"))


@query()
def recursive_splits(spark, d):
    out = columns.recursive_splits(load(spark, d, "msa"), "specimen", "read_id", "row_aln", 5, 0.1)
    return out.groupBy("specimen", "path").agg(F.count_if(~F.col("deferred")).alias("members"), F.count_if("deferred").alias("deferred"))


# ---- fitting


def _obs(spark, d):
    return runs.observations(load(spark, d, "msa"), "specimen", "read_id", "row_aln")


@query(oracle("""select specimen, start, called as mode from (select *, row_number() over (partition by specimen, start order by n desc, called) as r from (select specimen, start, called, count(*) as n from obs where other = 0 and called > 0 group by all)) where r = 1""", CELLS, _RID, _RUNS))
def run_modes(spark, d):
    m = fitting.modes(_obs(spark, d).where("status = 'clean'"), ["specimen", "start"], "called")
    return m.select("specimen", F.col("start").cast("long").alias("start"), F.col("mode").cast("long").alias("mode"))


_OUTLIERS = """tested as (select specimen, start, run_base, length, count(*) as n, count_if(called <> length)::bigint as k, count(*) over () as tests from obs where other = 0 and called > 0 group by specimen, start, run_base, length),
      wrong as (select tested.*, 1 - correct as p from tested join ctx using (run_base, length) where correct < 1 and correct > 0 and k > 0),
      outliers as (select specimen, start from (select specimen, start, tests, list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)) for i in range(k, n + 1)]) as tail from wrong) where tail < 0.2 / tests)"""
_TWO = """two as (select specimen, start from (select specimen, start, run_base, length, n, sum(n) over (partition by specimen, start) as everything, row_number() over (partition by specimen, start order by n desc, called) as r
      from (select specimen, start, run_base, length, called, count(*) as n from obs where other = 0 and called > 0 group by all)) join (select run_base, length, 1 - correct as wrong from ctx) using (run_base, length)
      where r = 2 and everything >= 20 and n > everything * 0.01 and n / everything::double > 0.5 * wrong)"""


@query(oracle("select specimen, start from outliers", CELLS, _RID, _RUNS, _OUTLIERS.replace("0.2 / tests", "100.0 / tests")))
def run_outliers(spark, d):
    """With a wide threshold, as the derived reads have few outliers."""
    o = runs.tally(_obs(spark, d), "specimen")
    return fitting.outliers(o, runs.by_context(o), "specimen", 100.0).withColumn("start", F.col("start").cast("long"))


@query(oracle("""select run_base, length, count(*) as n, round(avg((called = length)::int), 6) as correct, round(avg(called), 6) as mean from obs anti join (select * from outliers union select * from two) using (specimen, start)
    where other = 0 and called > 0 group by all""", CELLS, _RID, _RUNS, _OUTLIERS, _TWO))
def filtered_contexts(spark, d):
    c = fitting.second_pass(_obs(spark, d), "specimen", 0.2, 0.01, 0.5)
    return c.select("run_base", "length", "n", F.round("correct", 6).alias("correct"), F.round("mean", 6).alias("mean"))


_BINS = "case when reads >= 1000 then '1000-inf' when reads >= 500 then '500-1000' when reads >= 200 then '200-500' when reads >= 100 then '100-200' when reads >= 50 then '50-100' when reads >= 20 then '20-50' when reads >= 5 then '5-20' end"


@query(oracle(f"""select bin, count(*) as clusters, round(sum(subs) / sum(matches + subs + dels)::double, 9) as sub, round((sum(dels) + sum(ins)) / sum(matches + subs + dels)::double, 9) as indel from (select *, {_BINS} as bin from (
    select donor, any_value(ins) as ins, count_if(base = top)::bigint as matches, count_if(base <> top and base <> '-')::bigint as subs, count_if(base = '-')::bigint as dels, count(distinct read_id) as reads
    from (select donor, read_id, pos, base from (select donor, read_id, i - 1 as pos, substr(row_aln, i, 1) as base from msa, (select unnest(range(1, 97)) as i)))
    join (select donor, pos, c as top from donor_runs where length = 1) using (donor, pos) join dins using (donor) group by donor)) where bin is not null group by rollup (bin)""",
    """dcomp as (select donor, i - 1 as pos, substr(row_aln, i, 1) as base, count(*) as n from msa, (select unnest(range(1, 97)) as i) group by all),
      dfirst as (select donor, pos, base as c from (select *, row_number() over (partition by donor, pos order by n desc, instr('ACGT-', base)) as r from dcomp) where r = 1),
      dtop as (select * from dfirst where c <> '-'),
      dins as (select donor, sum(case when c = '-' and base <> '-' then n else 0 end)::bigint as ins from dcomp join dfirst using (donor, pos) group by donor),
      disle as (select *, sum(new) over (partition by donor order by pos) as run from (select donor, pos, c, case when c <> coalesce(lag(c) over (partition by donor order by pos), '') then 1 else 0 end as new from dtop)),
      donor_runs as (select donor, pos, c, count(*) over (partition by donor, run) as length from disle)"""))  # fmt: skip
def other_error_rates(spark, d):
    c = runs.other_errors(alignments.together(load(spark, d, "msa").select("donor", "read_id", "row_aln"), "donor"), "donor", "read_id", "row_aln")
    return fitting.other_rates(c, "reads").select("bin", "clusters", F.round("sub", 9).alias("sub"), F.round("indel", 9).alias("indel"))


@query(oracle("select specimen, ordinal, size, round(err_factor, 6)::double as err_factor from (select *, row_number() over (partition by specimen order by size desc, ordinal) as r from ids where gid = 1) where r = 1 and size >= 700 and err_factor < 1.0", _RANKED))
def qualifying_specimens(spark, d):
    q = fitting.qualifying(fitting.primary(_ids(spark, d), "specimen"), 700, 1.0)
    return q.select("specimen", "ordinal", "size", F.round("err_factor", 6).cast("double").alias("err_factor"))


@query(oracle("select model, n from (select concat('m', price % 7) as model, count(*) as n from msa where read_id % 4 <> 0 group by all) order by n desc, model limit 1"))
def dominant_model(spark, d):
    m = load(spark, d, "msa").select(F.when(F.col("read_id") % 4 != 0, F.concat(F.lit("m"), F.col("price") % 7)).alias("model"))
    return fitting.dominant(m, "model")


_CASE = "case read_id % 3 when 0 then 'non-hp-sub' when 1 then 'non-hp-indel' else 'hp' end"


@query(oracle(f"""select read_id, key, case key {' '.join(f"when '{k}' then {v}" for k, v in RATES.items())} end::double as rate from (
    select read_id, case when kind = 'hp' then concat('hp-l', read_id % 7 + 2) else kind end as key from (select read_id, {_CASE} as kind from msa))"""))
def rate_lookups(spark, d):
    r = load(spark, d, "msa")
    m = F.col("read_id") % 3
    key = fitting.rate_key(F.when(m == 0, "non-hp-sub").when(m == 1, "non-hp-indel").otherwise("hp"), F.col("read_id") % 7 + 2)
    return r.select("read_id", key.alias("key")).withColumn("rate", fitting.rate_of(F.col("key"), RATES))


# ---- records and reports


@query("""select o_orderkey, concat('s', o_custkey % 50, '-', o_orderkey % 9 + 1, '.v', o_orderkey % 5 + 1) as name, (o_orderkey % 100)::int as size, case when o_orderkey % 3 = 0 then 0 else 7 end::int as ric,
    case when o_orderkey % 4 <> 0 then (90 + o_orderkey % 10) / 100.0 end::double as rid, case when o_orderkey % 5 = 0 then 'p1+p2' end as primers, case when o_orderkey % 6 = 0 then '3+2' end as raw_ric,
    case when o_orderkey % 7 = 0 then 'inf' when o_orderkey % 7 = 1 then '1.250' end as cer, (o_orderkey % 9 + 1)::int as gid, case when o_orderkey % 11 = 0 then '1.v1+1.v2' end as chimera from orders""")
def header_fields(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    name = F.concat(F.lit("s"), F.col("o_custkey") % 50, F.lit("-"), k % 9 + 1, F.lit(".v"), k % 5 + 1)
    put = lambda cond, *text: F.when(cond, F.concat(*text))
    head = F.concat_ws(" ", name, F.concat(F.lit("size="), k % 100), put(k % 3 != 0, F.lit("ric=7")), put(k % 4 != 0, F.lit("rid="), (k % 10 + 90).cast("string"), F.lit(".0")), put(k % 5 == 0, F.lit("primers=p1,p2")), put(k % 6 == 0, F.lit("rawric=3+2")), put(k % 7 == 0, F.lit("cer_factor=inf")), put(k % 7 == 1, F.lit("cer_factor=1.250")), F.concat(F.lit("gid="), k % 9 + 1), put(k % 11 == 0, F.lit("chimera=1.v1+1.v2")))
    x = o.select(k, records.parse(head).alias("x"))
    cer = F.when(F.col("x.cer_factor") == float("inf"), "inf").when(F.col("x.cer_factor").isNotNull(), F.format_string("%.3f", "x.cer_factor"))
    return x.select("o_orderkey", "x.name", "x.size", "x.ric", "x.rid", F.array_join("x.primers", "+").alias("primers"), F.array_join("x.raw_ric", "+").alias("raw_ric"), cer.alias("cer"), F.col("x.gid").alias("gid"), "x.chimera")


_STATE = "case when err_factor > 1.5 then 'lq' when chimera is not null then 'chimera' when cer_factor < 1.0 then 'ns' else 'pass' end"


def _tracked(spark, d):
    return load(spark, d, "variants").withColumn("track", curation.track(F.col("cer_factor"), F.col("err_factor"), F.col("chimera")))


@query(oracle(f"""select track, count(*) as clusters, round(sum(err_factor * size) / sum(size), 6)::double as ratio, sum(size) >= 5000 as enough, coalesce(round(sum(err_factor * size) / sum(size), 6) between 0.7 and 1.4, false) as within
    from (select *, {_STATE} as track from variants) where track <> 'chimera' and err_factor is not null group by rollup (track)"""))
def calibration(spark, d):
    v = _tracked(spark, d).where("track <> 'chimera' and err_factor is not null").withColumn("observed", F.col("err_factor") * F.col("size"))
    c = curation.calibration(v, "track", "observed", "size", "size")
    return c.select("track", "clusters", F.round("ratio", 6).cast("double").alias("ratio"), "enough", "within")


@query(oracle(f"""select count_if(track = 'pass') as passed, count_if(track = 'pass' and err_factor > 1.3 and err_factor <= 1.5) as high_err, count_if(track = 'pass' and cer_factor > 1.0 and cer_factor <= 1.1) as border_cer,
    round(100.0 * count_if(track = 'ns') / count(*), 6)::double as ns_pct, round(100.0 * count_if(track = 'lq') / count(*), 6)::double as lq_pct, 100.0 * count_if(track = 'ns') / count(*) > 50 or 100.0 * count_if(track = 'lq') / count(*) > 20 as unusual from (select *, {_STATE} as track from variants)"""))
def parameter_signals(spark, d):
    return curation.parameter_signals(_tracked(spark, d), 1.5)


@query(oracle("""select ordinal, concat(specimen, '-', gid, '.v', vid) as filename, length(seq)::bigint as length, ric, row_number() over (partition by specimen order by gid, vid) as multiple from ids""", _RANKED))
def summary_rows(spark, d):
    v = _ids(spark, d).withColumn("filename", F.concat(F.col("specimen"), F.lit("-"), "gid", F.lit(".v"), "vid"))
    return curation.summary_rows(v, "specimen", ["gid", "vid"]).select("ordinal", "filename", F.length("seq").cast("long").alias("length"), "ric", F.col("multiple").cast("long").alias("multiple"))


_PARENTS = """peers as (select c.ordinal, p.ordinal as parent, p.size as parent_size, 1 - levenshtein(c.seq, p.seq) / greatest(length(c.seq), length(p.seq))::double as identity, levenshtein(c.seq, p.seq) as edits
      from ids c join ids p on c.specimen = p.specimen and c.gid = p.gid and (p.size > c.size or p.vorder = 1 and c.vorder <> 1)),
      best as (select *, row_number() over (partition by ordinal order by round(identity, 9) desc, parent_size desc, parent) as r from peers)"""
_ORDERED = _RANKED.replace("select v.*, gid,", "select v.*, gid, row_number() over (partition by v.specimen, v.grp order by size desc, ordinal) as vorder,")


@query(oracle("select ordinal, parent, round(identity, 6) as identity, concat(edits, ' edit', case when edits = 1 then '' else 's' end, ' (', printf('%.1f', round(100 * identity, 1)), '% id)') as text from best where r = 1", _ORDERED, _PARENTS))
def variant_parents(spark, d):
    p = curation.parents(_ids(spark, d), ["specimen", "gid"])
    text = F.concat(F.col("edits"), F.lit(" edit"), F.when(F.col("edits") == 1, "").otherwise("s"), F.lit(" ("), F.format_string("%.1f", F.round(100 * F.col("identity"), 1)), F.lit("% id)"))
    return p.select("ordinal", "parent", F.round("identity", 6).alias("identity"), text.alias("text"))


@query(oracle(f"""select ordinal, concat('size=', size, '  ric=', ric, '  ', track, case when cer_factor is not null then concat('  cer=', printf('%.2f', cer_factor::double)) else '' end, case when err_factor is not null then concat('  err=', printf('%.2f', err_factor::double)) else '' end) as metrics,
    concat(gid, '.v', vid, case track when 'pass' then '' else concat('.', track) end) as short from (select *, {_STATE} as track from ids)""", _RANKED))
def tree_labels(spark, d):
    v = _ids(spark, d).withColumn("track", curation.track(F.col("cer_factor"), F.col("err_factor"), F.col("chimera")))
    short = records.short_name(F.concat(F.col("specimen"), F.lit("-"), "gid", F.lit(".v"), "vid"), F.col("track"))
    return v.select("ordinal", records.metrics(F.col("size"), F.col("ric"), F.col("track"), F.col("cer_factor").cast("double"), F.col("err_factor").cast("double")).alias("metrics"), short.alias("short"))


@query(oracle(f"""select specimen, count(*) as clusters, coalesce(sum(size) filter (track = 'pass'), 0)::bigint as passed, round(100.0 * coalesce(sum(size) filter (track = 'pass'), 0) / sum(size), 6)::double as yield_pct,
    string_agg(distinct track, ',' order by track) as tracks from (select *, {_STATE} as track from variants) group by specimen"""))
def specimen_reports(spark, d):
    return curation.specimens(_tracked(spark, d), "specimen")


@query(oracle("""select specimen, gid, mask, size, snps from (select *, row_number() over (partition by specimen, gid order by size desc, mask) as r from (
    select s.specimen, s.gid, s.mask, any_value(s.size) as size, count_if(kinds > 1 and gaps = 0)::bigint as snps, count_if(gaps > 0 and gaps < members)::bigint as indels from (
      select m.specimen, m.gid, k.mask, sum(m.size)::bigint as size from few m join masks k on (k.mask // m.bit) % 2 = 1 group by all) s
    join (select m.specimen, m.gid, k.mask, i as pos, count(distinct nullif(substr(m.row, i, 1), '-')) as kinds, count_if(substr(m.row, i, 1) = '-') as gaps, count(*) as members
      from few m join masks k on (k.mask // m.bit) % 2 = 1, (select unnest(range(1, 97)) as i) group by all) c on c.specimen = s.specimen and c.gid = s.gid and c.mask = s.mask group by all) where snps <= 3 and indels <= 2) where r = 1""",
    _RANKED, "few as (select specimen, gid, size, row_aln as row, pow(2, r - 1)::bigint as bit from (select ids.*, row_aln, row_number() over (partition by ids.specimen, gid order by size desc, ordinal) as r from ids join msa on read_id = ordinal) where r <= 5)", "masks as (select unnest(range(1, 32)) as mask)"))
def mergeable_subsets(spark, d):
    rows = load(spark, d, "msa").select(F.col("read_id").alias("ordinal"), "row_aln")
    v = _ids(spark, d).join(rows, "ordinal")
    best = curation.mergeable(v, ["specimen", "gid"], "row_aln", 5, 3, 2)
    return best.withColumn("gid", F.col("gid").cast("long"))


@query(oracle("""select read_id, string_agg(case when x >= 6 then base when kind = 0 then '' when kind = 1 then concat(base, substr('ACGT', x % 4 + 1, 1)) else translate(base, 'ACGT', 'CGTA') end, '' order by i) as seq from (
    select read_id, i, substr(seq, i, 1) as base, instr('0123456789abcdef', substr(h, 1, 1)) * 16 + instr('0123456789abcdef', substr(h, 2, 1)) - 17 as x, (instr('0123456789abcdef', substr(h, 3, 1)) - 1) % 3 as kind
    from (select read_id, seq, i, md5(concat(read_id, ':', i)) as h from reads, (select unnest(range(1, 97)) as i) where i <= length(seq))) group by read_id"""))
def synthetic_reads(spark, d):
    r = load(spark, d, "reads").select("read_id", "seq")
    return alignments.with_errors(r, "read_id", "seq", 6)


@query(oracle("""select specimen, gid, mate, edits from (select a.specimen, a.gid, b.gid as mate, levenshtein(a.seq, b.seq) as edits, row_number() over (partition by a.specimen, a.gid order by levenshtein(a.seq, b.seq), b.gid) as r
    from anchors2 a join anchors2 b on a.specimen = b.specimen and a.gid < b.gid) where r = 1""", "dealt as (select * replace (ordinal % 97 as specimen) from variants)", _RANKED.replace("from variants", "from dealt"), "anchors2 as (select specimen, gid, arg_max(seq, size * 10000000000 - ordinal) as seq from ids group by all)"))
def nearest_groups(spark, d):
    v = load(spark, d, "variants").withColumn("specimen", F.col("ordinal") % 97)
    return curation.nearest_groups(curation.identity_ranks(v), "specimen").select("specimen", F.col("gid").cast("long").alias("gid"), F.col("mate").cast("long").alias("mate"), F.col("edits").cast("long").alias("edits"))


# ---- reads that are not aligned yet


@query(oracle("select specimen, string_agg(base, '' order by pos) as consensus from ranked where r = 1 and base <> '-' group by specimen", CELLS))
def aligned_consensus(spark, d):
    """From reads without their gaps; the SQL has the columns that they were made in."""
    few = graph.classes(load(spark, d, "reads"), "specimen", "read_id", "seq")
    return consensus.aligned_consensus(few, "specimen", "seq", "copies", 2)


_TEMPLATES = """hs as (select distinct specimen, hap, case when hap = 1 then concat(substr(tpl, 1, 19), translate(substr(tpl, 20, 1), 'ACGT', 'GTAC'), substr(tpl, 21)) when hap = 2 then concat(substr(tpl, 1, 69), translate(substr(tpl, 70, 1), 'ACGT', 'CATG'), substr(tpl, 71)) else tpl end as consensus from msa)"""


@query(oracle("select specimen, seq, hap, edits from (select r.specimen, r.seq, h.hap, levenshtein(r.seq, h.consensus)::bigint as edits, row_number() over (partition by r.specimen, r.seq order by levenshtein(r.seq, h.consensus), h.hap) as k from (select distinct specimen, seq from reads) r join hs h using (specimen)) where k = 1", _TEMPLATES))
def reassigned_reads(spark, d):
    m = load(spark, d, "msa")
    t = F.col("tpl")
    swap = lambda k, to: F.concat(F.substring(t, 1, k - 1), F.translate(F.substring(t, k, 1), "ACGT", to), F.substring(t, k + 1, 96))
    h = m.select("specimen", "hap", F.when(F.col("hap") == 1, swap(20, "GTAC")).when(F.col("hap") == 2, swap(70, "CATG")).otherwise(t).alias("consensus")).distinct()
    few = graph.classes(load(spark, d, "reads"), "specimen", "read_id", "seq")
    return consensus.reassigned(few, h, "specimen", "hap", "seq").withColumn("edits", F.col("edits").cast("long"))


#: Primers for exact reads: what is put before and after them, so the SQL can cut it off again.
_PRIMERS = (("f", "GATTACAGATTACAG"), ("r", "CCTTGGAACCTTGGA"))


@query(oracle("select read_id, seq, '5''-f+3''-r' as primers from reads"))
def trimmed_primers(spark, d):
    r = load(spark, d, "reads").select("read_id", F.concat(F.lit(_PRIMERS[0][1]), "seq", F.lit(_PRIMERS[1][1])).alias("seq"))
    x = r.select("read_id", pairwise.trimmed(F.col("seq"), list(_PRIMERS)).alias("x"))
    return x.select("read_id", "x.seq", F.array_join("x.primers", "+").alias("primers"))


@query(oracle("select read_id, case read_id % 3 when 0 then '+' when 1 then '-' end as strand, case when read_id % 3 < 2 then concat('GATTACAGATTACAG', seq, 'CCTTGGAACCTTGGA') else seq end as seq from reads"))
def oriented_reads(spark, d):
    """Reads with primers on one strand or the other, or without: kept, turned, or left as they are."""
    r = load(spark, d, "reads")
    whole = F.concat(F.lit(_PRIMERS[0][1]), "seq", F.lit(_PRIMERS[1][1]))
    r = r.select("read_id", F.when(F.col("read_id") % 3 == 0, whole).when(F.col("read_id") % 3 == 1, sequence.reverse_complement(whole)).otherwise(F.col("seq")).alias("seq"))
    return pairwise.oriented(r, "seq", _PRIMERS[0][1], "TCCAAGGTTCCAAGG", 2, 30).select("read_id", "strand", "seq")
