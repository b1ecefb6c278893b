"""The registered queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records, sequence
from ..operators import alignments, columns, curation, graph, pairwise, runs, significance
from .derived import CELLS, load, oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Error rates by context of a basecaller model, as an example table (parameter).
RATES = {"non-hp-sub": 0.0039, "non-hp-indel": 0.0027, "hp-l2": 0.006, "hp-l3": 0.009, "hp-l4": 0.013, "hp-l5": 0.02}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _comp(spark: SparkSession, d: str) -> DataFrame:
    return alignments.composition(load(spark, d, "msa"), "specimen", "read_id", "row_aln")


# ---- sequences and names


@query(oracle("select read_id, reverse(translate(seq, 'ACGT', 'TGCA')) as rc, reverse(qual) as rq from reads"))
def reverse_complement(spark, d):
    r = load(spark, d, "reads")
    return r.select("read_id", sequence.reverse_complement(F.col("seq")).alias("rc"), F.reverse("qual").alias("rq"))


@query(oracle("select read_id, round(list_sum([ord(c) - 33 for c in string_split(qual, '')]) / length(qual)::double, 6) as mean_q from reads"))
def mean_read_quality(spark, d):
    return load(spark, d, "reads").select("read_id", F.round(sequence.mean_quality(F.col("qual")), 6).alias("mean_q"))


_QUALITY = "q as (select *, list_sum([ord(c) - 33 for c in string_split(qual, '')]) / length(qual)::double as mean_q from reads)"


@query(oracle("select specimen, read_id, r from (select specimen, read_id, row_number() over (partition by specimen order by mean_q desc, read_id) as r from q) where r <= 50", _QUALITY))
def presample_by_quality(spark, d):
    r = load(spark, d, "reads").withColumn("mean_q", sequence.mean_quality(F.col("qual")))
    by = Window.partitionBy("specimen").orderBy(F.desc("mean_q"), "read_id")
    return r.withColumn("r", F.row_number().over(by)).where("r <= 50").select("specimen", "read_id", F.col("r").cast("long").alias("r"))


@query(oracle("select read_id, len(regexp_extract_all(seq, 'A+|C+|G+|T+'))::bigint as sites from reads"))
def independent_sites(spark, d):
    return load(spark, d, "reads").select("read_id", sequence.run_count(F.col("seq")).cast("long").alias("sites"))


@query(oracle("""select read_id, base, start::bigint as start, length::bigint as length from (
    select read_id, substr(parts[i], 1, 1) as base, coalesce(list_sum([length(x) for x in parts[1:i - 1]]), 0) as start, length(parts[i]) as length
    from (select read_id, regexp_extract_all(seq, 'A+|C+|G+|T+') as parts from reads), (select unnest(range(1, 97)) as i) where i <= len(parts)) where length >= 3"""))  # fmt: skip
def homopolymer_runs(spark, d):
    r = columns.anchors_of_rows(load(spark, d, "reads"), "read_id", "seq", 96, 3)  # a read without gaps is its own row
    return r.select("read_id", F.col("run_base").alias("base"), F.col("run_start").cast("long").alias("start"), F.col("run_length").alias("length"))


@query(oracle("select len, count(*) as n_reads, sum(len)::bigint as bases from (select length(seq) as len from reads) group by len"))
def length_histogram(spark, d):
    return load(spark, d, "reads").groupBy(F.length("seq").cast("long").alias("len")).agg(F.count("*").alias("n_reads"), F.sum(F.length("seq")).alias("bases"))


@query(oracle("select seq, count(*) as copies, min(read_id) as first, specimen from reads group by specimen, seq"))
def sequence_classes(spark, d):
    return graph.classes(load(spark, d, "reads"), "specimen", "read_id", "seq")


@query("""select o_orderkey, concat('s', o_custkey % 50) as specimen, (o_orderkey % 9 + 1)::varchar as gid, concat('v', o_orderkey % 5 + 1) as vid,
    case when o_orderkey % 3 = 0 then null else (o_orderkey % 100)::varchar end as size from orders""")
def record_names(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    name = F.concat(F.lit("s"), F.col("o_custkey") % 50, F.lit("-"), F.col("o_orderkey") % 9 + 1, F.lit(".v"), F.col("o_orderkey") % 5 + 1)
    head = F.concat_ws(" ", name, F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("size="), F.col("o_orderkey") % 100)), F.lit("rawric=7"))
    o = o.select("o_orderkey", name.alias("name"), head.alias("head"))
    return o.select("o_orderkey", records.specimen_of(F.col("name")).alias("specimen"), records.group_of(F.col("name")).alias("gid"), records.variant_of(F.col("name")).alias("vid"), records.field(F.col("head"), "size").alias("size"))


@query(oracle("""select ordinal, concat_ws(' ', concat('x', ordinal), concat('size=', size), concat('ric=', ric), concat('cer_factor=', printf('%.3f', cer_factor::double)), concat('gid=', grp)) as header
    from (select ordinal, size, ric, grp, cer_factor from variants) where cer_factor is not null"""))
def fasta_headers(spark, d):
    v = load(spark, d, "variants").where("cer_factor is not null")
    no = F.lit(None)
    h = records.header(F.concat(F.lit("x"), F.col("ordinal")), F.col("size"), F.col("ric"), no.cast("double"), no.cast("double"), no.cast("array<string>"), no.cast("int"), F.col("cer_factor").cast("double"), no.cast("double"), F.col("grp"), no.cast("int"))
    return v.select("ordinal", h.alias("header"))


@query("select l_orderkey, l_linenumber, l_partkey, least(40, greatest(0, round(-10 * log10(l_discount + 0.001))))::int as phred from lineitem")
def phred_of_error(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", sequence.phred_of_error(F.col("l_discount") + 0.001).alias("phred"))


# ---- columns of alignments


@query(oracle("select specimen, pos, base, n from comp", CELLS))
def positional_composition(spark, d):
    return _comp(spark, d).withColumn("pos", F.col("pos").cast("long"))


@query(oracle("""select specimen, pos, string_agg(base, '' order by base) as alleles, count(*) as n_variants from ranked
    where r > 1 and n >= 3 and n >= total * 0.1 group by specimen, pos""", CELLS))  # fmt: skip
def variant_columns(spark, d):
    return alignments.variant_columns(_comp(spark, d), "specimen", 0.1, 3).withColumn("pos", F.col("pos").cast("long"))


@query(oracle("""select donor, pos, top, total from (select donor, pos, max(n) as top, sum(n)::bigint as total from (select donor, i - 1 as pos, substr(row_aln, i, 1) as base, count(*) as n from msa, (select unnest(range(1, 97)) as i) group by all) where base <> '-' group by all)
    where total >= 2 and top * 2 <= total"""))  # fmt: skip
def columns_without_majority(spark, d):
    rows = alignments.together(load(spark, d, "msa").select("donor", "read_id", "row_aln"), "donor")
    comp = alignments.composition(rows, "donor", "read_id", "row_aln")
    return alignments.without_majority(comp, "donor").withColumn("pos", F.col("pos").cast("long"))


_MASK = "case base when 'A' then 1 when 'C' then 2 when 'G' then 4 when 'T' then 8 else 0 end"


@query(oracle(f"""select specimen, string_agg(code, '' order by pos) as consensus, count_if(code not in ('A', 'C', 'G', 'T'))::bigint as n_ambiguous
    from (select specimen, pos, substr('ACMGRSVTWYHKDBN', mask, 1) as code, first from (
      select specimen, pos, bit_or(case when r = 1 or base <> '-' and (n >= 3 and n >= total * 0.1 or bases >= 2 and top * 2 <= bases) then {_MASK} else 0 end)::int as mask, max(case when r = 1 then base end) as first
      from (select *, sum(case when base <> '-' then n end) over (partition by specimen, pos) as bases, max(case when base <> '-' then n end) over (partition by specimen, pos) as top from ranked) group by all)
    where first <> '-') group by specimen""", CELLS))  # fmt: skip
def ambiguous_consensus(spark, d):
    return alignments.ambiguous_consensus(_comp(spark, d), "specimen", 0.1, 3)


@query(oracle(f"""select specimen, string_agg(substr('ACMGRSVTWYHKDBN', mask, 1), '' order by pos) as consensus, count_if(mask not in (1, 2, 4, 8))::bigint as snp_count
    from (select specimen, pos, bit_or({_MASK})::int as mask, sum(w) as everything, sum(case when base <> '-' then w else 0 end) as bases
          from cells join (select read_id, price % 9 + 1 as w from msa) using (read_id) group by all) where bases >= everything * 0.5 and bases >= 3 group by specimen""", CELLS))  # fmt: skip
def weighted_consensus(spark, d):
    rows = load(spark, d, "msa").withColumn("w", F.col("price") % 9 + 1)
    return alignments.weighted_consensus(rows, "specimen", "read_id", "row_aln", "w")


_RID = """c as (select specimen, pos, base as c from ranked where r = 1), len as (select specimen, count(*) as bases from c where c <> '-' group by specimen),
      rid as (select cells.specimen, read_id, 1 - count_if(base <> c) / any_value(bases)::double as rid from cells join c using (specimen, pos) join len using (specimen) group by all)"""


@query(oracle("select specimen, read_id, round(rid, 6) as rid from rid", CELLS, _RID))
def read_identity(spark, d):
    rows = load(spark, d, "msa")
    rids = alignments.read_identities(rows, alignments.composition(rows, "specimen", "read_id", "row_aln"), "specimen", "read_id", "row_aln")
    return rids.withColumn("rid", F.round("rid", 6))


@query(oracle("select specimen, round(avg(rid), 6) as rid, round(min(rid), 6) as rid_min, count(*) as n_reads from rid group by specimen", CELLS, _RID))
def cluster_identity(spark, d):
    rows = load(spark, d, "msa")
    rids = alignments.read_identities(rows, alignments.composition(rows, "specimen", "read_id", "row_aln"), "specimen", "read_id", "row_aln")
    return rids.groupBy("specimen").agg(F.round(F.avg("rid"), 6).alias("rid"), F.round(F.min("rid"), 6).alias("rid_min"), F.count("*").alias("n_reads"))


@query(oracle("""select specimen, read_id, members >= 3 and median - rid >= 0.01 and (0.6745 * (rid - median) / greatest(mad, 0.002) < -1.5
      or coalesce(rid = worst and case when best - second > 1e-9 then second - worst > 2.5 * (best - second) else second - worst > 0.01 end, false)) as outlier
    from (select *, median(abs(rid - median)) over (partition by specimen) as mad from (select *, median(rid) over (partition by specimen) as median, count(*) over (partition by specimen) as members,
      min(rid) over (partition by specimen) as worst, max(rid) over (partition by specimen) as best, nth_value(rid, 2) over (partition by specimen order by rid rows between unbounded preceding and unbounded following) as second
      from (select specimen, read_id, round(rid, 6) as rid from rid)))""", CELLS, _RID))  # fmt: skip
def identity_outliers(spark, d):
    return alignments.identity_outliers(read_identity(spark, d), "specimen", drop=0.01).select("specimen", "read_id", "outlier")


@query(oracle(f"""select specimen, round(sum(share), 6) as observed, round(sum(rate), 6) as expected, count(*) as columns, round(sum(share) / sum(rate), 6) as err_factor from (
    select specimen, pos, share, case length when 1 then {RATES['non-hp-sub'] + RATES['non-hp-indel']} when 2 then {RATES['hp-l2']} when 3 then {RATES['hp-l3']} when 4 then {RATES['hp-l4']} when 5 then {RATES['hp-l5']} else {1.5 * RATES['hp-l5']} end as rate
    from (select specimen, pos, count(*) over (partition by specimen, run) as length from (select *, sum(new) over (partition by specimen order by pos) as run from (
           select specimen, pos, case when c <> coalesce(lag(c) over (partition by specimen order by pos), '') then 1 else 0 end as new from c where c <> '-')))
    join (select specimen, pos, sum(case when base <> c then n else 0 end) / sum(n)::double as share from comp join c using (specimen, pos) group by all) using (specimen, pos)) group by specimen""", CELLS, _RID))  # fmt: skip
def error_factor(spark, d):
    rows = load(spark, d, "msa")
    out = alignments.expected_error(rows, alignments.composition(rows, "specimen", "read_id", "row_aln"), RATES, "specimen")
    return out.select("specimen", *(F.round(c, 6).alias(c) for c in ("observed", "expected")), "columns", F.round("err_factor", 6).alias("err_factor"))


_VARIANT = "v as (select specimen, pos from ranked where r > 1 and n >= 3 and n >= total * 0.05 group by all), sites as (select cells.* from cells join v using (specimen, pos))"


def _at(spark, d):
    rows = load(spark, d, "msa")
    comp = alignments.composition(rows, "specimen", "read_id", "row_aln")
    pos = alignments.variant_columns(comp, "specimen", 0.05, 3).select("specimen", "pos")
    return alignments.cells_at(rows, pos, "specimen", "read_id", "row_aln"), pos


@query(oracle("""select specimen, pos, base as allele, n as members from (select specimen, pos, base, n, sum(n) over (partition by specimen, pos) as total from (select specimen, pos, base, count(*) as n from sites group by all)) where n >= 3 and n >= total * 0.05""", CELLS, _VARIANT))
def haplotypes(spark, d):
    c, pos = _at(spark, d)
    return alignments.haplotypes(c, pos, "specimen", "read_id", 3, 0.05).withColumn("pos", F.col("pos").cast("long"))


@query(oracle("""select specimen, k_pos as pos, round(sum(e * members) / sum(members), 6) as error from (select specimen, k_pos, allele, members, avg(e) as e from (
      select specimen, k_pos, allele, members, pos, 1 - max(n) / sum(n)::double as e from (select s.specimen, s.pos as k_pos, s.base as allele, g.members, o.pos, o.base, count(*) as n
        from sites s join g on g.specimen = s.specimen and g.pos = s.pos and g.base = s.base join (select specimen, pos from g group by all having count(*) >= 2) k on k.specimen = s.specimen and k.pos = s.pos
        join sites o on o.specimen = s.specimen and o.read_id = s.read_id group by all) group by all) group by all) group by all""",
    CELLS, _VARIANT, "g as (select specimen, pos, base, n as members from (select specimen, pos, base, n, sum(n) over (partition by specimen, pos) as total from (select specimen, pos, base, count(*) as n from sites group by all)) where n >= 3 and n >= total * 0.05)"))
def phasing_errors(spark, d):
    c, pos = _at(spark, d)
    out = alignments.phasing_errors(c, pos, "specimen", "read_id", 3, 0.05)
    return out.select("specimen", F.col("pos").cast("long").alias("pos"), F.round("error", 6).alias("error"))


# ---- graphs

_FEW = "few as (select donor, min(read_id) as read_id, seq from reads group by donor, seq)"
_PAIRS = """pairs as (select a.donor, a.read_id as src, b.read_id as dst, greatest(length(a.seq), length(b.seq)) as l, levenshtein(a.seq, b.seq) as d
      from few a join few b on a.donor = b.donor and a.read_id < b.read_id),
      edges as (select donor, src, dst, 1 - d / l::double as sim from pairs where d <= floor((1.0 - 0.97::double) * l))"""


def _few(spark, d):
    return graph.classes(load(spark, d, "reads"), "donor", "read_id", "seq").withColumnRenamed("first", "read_id")


def _edges(spark, d):
    few = _few(spark, d)
    return graph.edges(few, "donor", "read_id", "seq", 0.97, k=24)


@query(oracle("select donor, src, dst, round(sim, 6) as sim, round(sim * sim, 6) as weight from edges", _FEW, _PAIRS))
def similarity_edges(spark, d):
    e = graph.weights(_edges(spark, d))
    return e.select("donor", "src", "dst", F.round("sim", 6).alias("sim"), "weight")


@query(oracle("select donor, src, dst, round(sim, 6) as sim from (select *, row_number() over (partition by donor, src order by round(sim, 9) desc, dst) as r from edges) where r <= 5", _FEW, _PAIRS))
def nearest_neighbours(spark, d):
    e = _edges(spark, d).withColumn("sim", F.round("sim", 9))
    return graph.nearest(e, "donor", 5).withColumn("sim", F.round("sim", 6))


@query(oracle("""select donor, read_id, min(seen) as component from reach group by donor, read_id""", _FEW, _PAIRS,
    "reach as (select donor, read_id, read_id as seen from few union select reach.donor, read_id, case when seen = src then dst else src end from reach join edges on reach.donor = edges.donor and seen in (src, dst))"))
def equivalence_groups(spark, d):
    few = _few(spark, d)
    return graph.components(few, _edges(spark, d), "donor", "read_id")


@query(oracle("""select donor, arg_max(node, k * 10000000000 - node) as centre, max(k) as degree from (
    select donor, node, count(*) as k from (select donor, src as node from edges union all select donor, dst from edges) group by all) group by donor""", _FEW, _PAIRS))  # fmt: skip
def star_centres(spark, d):
    return graph.star_centres(_edges(spark, d), "donor")


@query()
def greedy_clusters(spark, d):
    few = _few(spark, d)
    return graph.greedy_clusters(few, _edges(spark, d), "donor", "read_id")


@query()
def flow_clusters(spark, d):
    few = _few(spark, d)
    return graph.flow_clusters(few, graph.weights(_edges(spark, d)), "donor", "read_id")


@query()
def linkage_groups(spark, d):
    few = _few(spark, d)
    return graph.linkage_groups(few, _edges(spark, d).withColumn("distance", 1 - F.col("sim")), "donor", "read_id", 0.02)


# ---- significance


@query()
def variant_significance(spark, d):
    v = variant_columns_with_counts(spark, d)
    q = significance.log_critical_of("total", "n", F.lit(96), F.lit(1))
    out = v.withColumn("log_q", q)
    return out.select("specimen", "pos", "base", "n", "total", F.round("log_q", 6).alias("log_q"), F.round(significance.factor(F.col("log_q"), F.log(F.lit(RATES["non-hp-sub"])), F.lit(1)), 6).alias("cer_factor"))


def variant_columns_with_counts(spark, d):
    comp = _comp(spark, d)
    by = Window.partitionBy("specimen", "pos")
    r = comp.withColumn("total", F.sum("n").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), alignments.allele_rank(F.col("base")))))
    return r.where("r > 1 and n >= 3").drop("r")


@query(oracle("""select specimen, pos, base, round(ln(p), 4) as log_p from (select specimen, pos, base, list_sum([exp(lgamma(total + 1) - lgamma(k + 1) - lgamma(total - k + 1) + k * ln(0.0039) + (total - k) * ln(1 - 0.0039))
    for k in range(n, total + 1)]) as p from (select specimen, pos, base, n, total::bigint as total from ranked where r > 1 and n >= 3)) where p > 1e-200""", CELLS))  # fmt: skip
def binomial_tails(spark, d):
    v = variant_columns_with_counts(spark, d).withColumn("log_p", significance.log_tail_of("n", "total", F.lit(0.0039)))
    return v.where(F.col("log_p") > F.lit(-200 * 2.302585092994046)).select("specimen", F.col("pos").cast("long").alias("pos"), "base", F.round("log_p", 4).alias("log_p"))


# ---- curation

_RANKED = """anchors as (select specimen, grp, max(size) as anchor, min(ordinal) as first from variants group by all),
      gids as (select specimen, grp, row_number() over (partition by specimen order by anchor desc, first) as gid from anchors),
      ids as (select v.*, gid, row_number() over (partition by v.specimen, v.grp order by ((cer_factor is null or cer_factor >= 1.0) and (err_factor is null or err_factor <= 1.5)) desc, size desc, ordinal) as vid
              from variants v join gids using (specimen, grp))"""


def _ids(spark, d):
    return curation.identity_ranks(load(spark, d, "variants"))


@query(oracle("select ordinal, specimen, gid, vid from ids", _RANKED))
def identity_ranks(spark, d):
    return _ids(spark, d).select("ordinal", "specimen", F.col("gid").cast("long").alias("gid"), F.col("vid").cast("long").alias("vid"))


_TRACK = "case when err_factor > 1.5 then 'lq' when chimera is not null then 'chimera' when cer_factor < 1.0 then 'ns' else 'pass' end"


@query(oracle(f"select ordinal, {_TRACK} as track from variants"))
def tracks(spark, d):
    v = load(spark, d, "variants")
    return v.select("ordinal", curation.track(F.col("cer_factor"), F.col("err_factor"), F.col("chimera")).alias("track"))


@query(oracle("select specimen, gid, total, gid <> 1 and total < 0.2 * max(total) over (partition by specimen) and total < 4000 as pruned from (select specimen, gid, sum(size)::bigint as total from ids group by all)", _RANKED))
def pruned_groups(spark, d):
    return curation.pruned_groups(_ids(spark, d), 0.2, 4000).withColumn("gid", F.col("gid").cast("long"))


@query(oracle("select ordinal, gid, vid from (select *, row_number() over (partition by specimen, gid order by size desc, ordinal) as r, max(size) over (partition by specimen, gid) as largest from ids) where (size = largest or size >= largest * 0.3) and r <= 3", _RANKED))
def selected_variants(spark, d):
    return curation.selected(_ids(spark, d), 3, 0.3).select("ordinal", F.col("gid").cast("long").alias("gid"), F.col("vid").cast("long").alias("vid"))


@query(oracle("""select ordinal, size from (select *, min(ok) over (partition by specimen, gid order by size desc, ordinal rows unbounded preceding) as all_ok from (
    select *, case when size >= 0.1 * coalesce(sum(size) over (partition by specimen, gid order by size desc, ordinal rows between unbounded preceding and 1 preceding), 0) then 1 else 0 end as ok from ids)) where all_ok = 1""", _RANKED))  # fmt: skip
def gated_variants(spark, d):
    return curation.gated(_ids(spark, d), 0.1).select("ordinal", "size")


@query(oracle("""select ordinal, (case when everything <= 500 then size else whole + (case when r <= missing then 1 else 0 end) end)::bigint as reads from (
    select *, 500 - sum(whole) over (partition by specimen, gid) as missing, row_number() over (partition by specimen, gid order by round(share - whole, 9) desc, size desc, ordinal) as r
    from (select *, floor(share) as whole from (select *, size * 500.0::double / sum(size) over (partition by specimen, gid) as share, sum(size) over (partition by specimen, gid) as everything from ids)))""", _RANKED))  # fmt: skip
def allocated_reads(spark, d):
    return curation.allocated(_ids(spark, d), 500).select("ordinal", "reads")


@query(oracle("""select specimen, gid, sum(size)::bigint as size, sum(ric)::bigint as ric, string_agg(ric::varchar, '+' order by ric desc) as raw_ric, string_agg(length(seq)::varchar, '+' order by length(seq) desc) as raw_len,
    string_agg(distinct concat('p', ordinal % 3), ',' order by concat('p', ordinal % 3)) as primers, arg_max(seq, size * 10000000000 - ordinal) as seq from ids group by specimen, gid""", _RANKED))  # fmt: skip
def merged_records(spark, d):
    v = _ids(spark, d).withColumn("gid", F.col("gid").cast("long")).withColumn("primers", F.array(F.concat(F.lit("p"), F.col("ordinal") % 3)))
    return curation.merged(v, ["specimen", "gid"])


@query(oracle("select ordinal from ids join (select specimen, gid from (select specimen, gid, row_number() over (partition by specimen order by max(size) desc, gid) as r from ids group by specimen, gid) where r <= 2) using (specimen, gid)", _RANKED))
def largest_groups(spark, d):
    return curation.groups_by_anchor(_ids(spark, d), 2).select("ordinal")


# ---- reports


@query(oracle(f"""select quantile_cont(ric, 0.25)::double as ric_q1, quantile_cont(ric, 0.5)::double as ric_median, quantile_cont(ric, 0.75)::double as ric_q3, count(*) as n_variants, count(distinct specimen) as n_specimens,
    round(100.0 * sum(case when track = 'pass' then size else 0 end) / sum(size), 6)::double as yield_pct from (select *, {_TRACK} as track from variants)"""))
def executive_summary(spark, d):
    v = load(spark, d, "variants").withColumn("track", curation.track(F.col("cer_factor"), F.col("err_factor"), F.col("chimera")))
    q = lambda p: F.percentile("ric", F.lit(p))
    passed = F.sum(F.when(F.col("track") == "pass", F.col("size")).otherwise(0))
    return v.agg(q(0.25).alias("ric_q1"), q(0.5).alias("ric_median"), q(0.75).alias("ric_q3"), F.count("*").alias("n_variants"), F.countDistinct("specimen").alias("n_specimens"), F.round(100.0 * passed / F.sum("size"), 6).alias("yield_pct"))


@query(oracle(f"""select track, count(*) as n, sum(size)::bigint as size, round(avg(err_factor)::double, 6) as err from (select *, coalesce({_TRACK}, '') as track from variants) group by rollup (track)"""))
def track_shares(spark, d):
    v = load(spark, d, "variants").withColumn("track", curation.track(F.col("cer_factor"), F.col("err_factor"), F.col("chimera")))
    return v.rollup("track").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.round(F.avg(F.col("err_factor").cast("double")), 6).alias("err"))


@query(oracle("""select ordinal, size from (select *, row_number() over (order by size desc, ordinal) as r from (select ordinal, size, avg(size) over () as m, stddev_pop(size) over () as s from variants) where size > greatest(m + 1.5 * s, 100)) where r <= 20"""))
def high_outliers(spark, d):
    v = load(spark, d, "variants").select("ordinal", "size")
    limit = v.agg(F.greatest(F.avg("size") + 1.5 * F.stddev_pop("size"), F.lit(100.0)).alias("limit"))
    return v.join(F.broadcast(limit), F.col("size") > F.col("limit")).orderBy(F.desc("size"), "ordinal").limit(20).select("ordinal", "size")


@query(oracle("""select specimen, sum(size)::bigint as reads, round(100.0 * sum(case when cer_factor is null or cer_factor >= 1 then size else 0 end) / sum(size), 6)::double as yield_pct from variants group by specimen
    having yield_pct < (select quantile_cont(y, 0.25) from (select round(100.0 * sum(case when cer_factor is null or cer_factor >= 1 then size else 0 end) / sum(size), 6)::double as y from variants group by specimen))"""))
def low_yield_specimens(spark, d):
    ok = F.col("cer_factor").isNull() | (F.col("cer_factor") >= 1)
    s = load(spark, d, "variants").groupBy("specimen").agg(F.sum("size").alias("reads"), F.round(100.0 * F.sum(F.when(ok, F.col("size")).otherwise(0)) / F.sum("size"), 6).alias("yield_pct"))
    limit = s.agg(F.percentile("yield_pct", F.lit(0.25)).alias("limit"))
    return s.join(F.broadcast(limit), F.col("yield_pct") < F.col("limit")).drop("limit")


# ---- pairwise alignment


@query(oracle("""select donor, a.read_id, levenshtein(a.seq, b.seq)::bigint as edits from few a join (select donor, arg_min(seq, read_id) as seq from few group by donor) b using (donor)""", _FEW.replace("select specimen", "select donor").replace("group by specimen", "group by donor")))
def variant_differences(spark, d):
    few = _few(spark, d)
    ref = few.groupBy("donor").agg(F.min_by("seq", "read_id").alias("ref"))
    x = few.join(ref, "donor").withColumn("x", pairwise.differences("seq", "ref"))
    return x.select("donor", "read_id", F.col("x.edits").cast("long").alias("edits"))


@query()
def difference_tags(spark, d):
    few = _few(spark, d)
    ref = few.groupBy("donor").agg(F.min_by("seq", "read_id").alias("ref"))
    x = few.join(ref, "donor").withColumn("x", pairwise.differences("seq", "ref"))
    return x.select("donor", "read_id", "x.subs", "x.indel1", "x.indel3", "x.indel_long", F.array_join("x.tags", ",").alias("tags"), F.round("x.run_distance", 6).alias("run_distance"))


@query()
def read_orientation(spark, d):
    r = load(spark, d, "reads").withColumn("rc", sequence.reverse_complement(F.col("seq")))
    o = r.withColumn("strand", pairwise.orientation(F.col("seq"), F.col("rc"), "ACGTACGTAC", "GTRCGTACGT", 2, 40))
    return o.groupBy("strand").agg(F.count("*").alias("n_reads"))


# ---- homopolymer runs and recombinants

_RUNS = """isle as (select *, sum(new) over (partition by specimen order by pos) as run from (select specimen, pos, c, case when c <> coalesce(lag(c) over (partition by specimen order by pos), '') then 1 else 0 end as new from c where c <> '-')),
      cruns as (select specimen, pos, c as run_base, min(pos) over (partition by specimen, run) as start, count(*) over (partition by specimen, run) as length from isle),
      obs as (select specimen, start, run_base, length, read_id, count_if(base = run_base)::bigint as called, count_if(base <> '-' and base <> run_base) as other from cells join cruns using (specimen, pos) where length >= 2 group by all),
      ctx as (select run_base, length, count(*) as n, avg((called = length)::int) as correct, avg((called = length - 1)::int) as minus1, avg(called) as mean, stddev_pop(called) as std from obs where other = 0 and called > 0 group by all)"""


@query(oracle("select run_base, length, n, round(correct, 6) as correct, round(minus1, 6) as minus1, round(mean, 6) as mean, round(std, 6) as std from ctx", CELLS, _RID, _RUNS))
def run_contexts(spark, d):
    c = runs.by_context(runs.observations(load(spark, d, "msa"), "specimen", "read_id", "row_aln"))
    return c.select("run_base", "length", "n", *(F.round(x, 6).alias(x) for x in ("correct", "minus1", "mean", "std")))


@query(oracle("select concat('hp-l', length) as key, round(sum((1 - correct ** (1.0::double / length)) * n) / sum(n), 6) as rate from ctx where length <= 5 group by length", CELLS, _RID, _RUNS))
def run_rates(spark, d):
    c = runs.by_context(runs.observations(load(spark, d, "msa"), "specimen", "read_id", "row_aln"))
    return runs.rates(c).withColumn("rate", F.round("rate", 6))


@query(oracle("""select specimen, start from (select specimen, start, run_base, length, n, sum(n) over (partition by specimen, start) as everything, row_number() over (partition by specimen, start order by n desc, called) as r
    from (select specimen, start, run_base, length, called, count(*) as n from obs where other = 0 and called > 0 group by all)) join (select run_base, length, 1 - correct as wrong from ctx) using (run_base, length)
    where r = 2 and everything >= 20 and n > everything * 0.01 and n / everything::double > 0.5 * wrong""", CELLS, _RID, _RUNS))  # fmt: skip
def bimodal_runs(spark, d):
    obs = runs.tally(runs.observations(load(spark, d, "msa"), "specimen", "read_id", "row_aln"), "specimen")
    return runs.bimodal(obs, runs.by_context(obs), "specimen", 0.01, 0.5).withColumn("start", F.col("start").cast("long"))


@query(oracle("""select specimen, count_if(base = run_base)::bigint as matches, count_if(base <> run_base and base <> '-')::bigint as subs, count_if(base = '-')::bigint as dels, any_value(ins) as ins, count(distinct read_id) as reads
    from cells join cruns using (specimen, pos) join (select specimen, sum(case when t.base = '-' and c.base <> '-' then c.n else 0 end)::bigint as ins from comp c join ranked t using (specimen, pos) where t.r = 1 group by specimen) using (specimen) where length = 1 group by specimen""", CELLS, _RID, _RUNS))  # fmt: skip
def other_errors(spark, d):
    return runs.other_errors(load(spark, d, "msa"), "specimen", "read_id", "row_aln")


#: Of each template, its reverse and a recombinant of both.
_PLANTED = "planted as (select specimen, tpl as a, reverse(tpl) as b from (select distinct specimen, tpl from msa)), sites as (select specimen, i from planted, (select unnest(range(1, 97)) as i) where substr(a, i, 1) <> substr(b, i, 1))"


@query(oracle("""select specimen, 3 as candidate, 1 as a, 2 as b, count(*) as sites, (max(i) filter (i <= 48) - 1)::bigint as at, 0::bigint as mismatches, least(count_if(i <= 48), count_if(i > 48))::bigint as gain from sites group by specimen""", _PLANTED))
def chimeras(spark, d):
    t = load(spark, d, "msa").select("specimen", "tpl").distinct()
    a, b = F.col("tpl"), F.reverse("tpl")
    each = ((1, 100, a), (2, 90, b), (3, 10, F.concat(F.substring(a, 1, 48), F.substring(b, 49, 48))))
    rows = t.select("specimen", F.explode(F.array(*(F.struct(F.lit(i).alias("name"), F.lit(n).alias("size"), x.alias("row_aln")) for i, n, x in each))).alias("x")).select("specimen", "x.*")
    return runs.chimeras(rows, "specimen", "name", "size", "row_aln")


from . import analysis, gapped, joined, validated  # noqa: E402, F401  register more queries
