"""Queries on merging: clusters that differ in runs alone, overlaps of different primers, groups that contract, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging, overlap, variant_merge
from .derived import gapped_oracle, load, oracle
from .queries import query

#: Clusters of a specimen: its template with two runs of other lengths, and some with another base between.
_CLUSTERS = """clusters as (select read_id as cluster, specimen, price % 997 + 1 as size, (read_id % 3)::int as source, substr('ACGT', (read_id % 4)::int + 1, 1) as allele,
                      concat(substr(tpl, 1, 40), repeat('A', (read_id % 5)::int + 3), case when read_id % 11 = 0 then 'T' else 'C' end, repeat('G', (floor(read_id / 7) % 5)::int + 3), substr(tpl, 41)) as seq from msa),
      forms0 as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A{6,}', 'AAAAAA', 'g'), 'C{6,}', 'CCCCCC', 'g'), 'G{6,}', 'GGGGGG', 'g'), 'T{6,}', 'TTTTTT', 'g') as form from clusters),
      forms as (select specimen, form, first(cluster order by size desc, cluster) as first, max(size) as size, regexp_replace(regexp_replace(regexp_replace(regexp_replace(form, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g') as bare,
                       [length(x) for x in regexp_extract_all(form, 'A+|C+|G+|T+')] as lengths from forms0 group by specimen, form),
      ranked_forms as (select *, row_number() over (partition by specimen, bare order by size desc, first) as k, count(*) over (partition by specimen, bare) as forms_n from forms),
      steps as (select specimen, bare, 1::bigint as k, [{'first': first, 'lengths': lengths}] as heads, first as form_first, first as into_ from ranked_forms where k = 1
                union all select specimen, bare, k, case when hit is null then list_append(heads, {'first': first, 'lengths': lengths}) else heads end, first, coalesce(hit, first)
                from (select s.specimen, s.bare, f.k, s.heads, f.first, f.lengths, list_extract([h.first for h in s.heads if len([1 for z in list_zip(h.lengths, f.lengths) if z[1] <> z[2] and greatest(z[1], z[2]) < 6]) = 0], 1) as hit
                      from steps s join ranked_forms f on s.specimen = f.specimen and s.bare = f.bare and f.k = s.k + 1)),
      classes as (select c.specimen, cluster, into_ as into_cluster from forms0 c join forms using (specimen, form) join steps on steps.specimen = c.specimen and steps.bare = forms.bare and steps.form_first = forms.first)"""


def _clusters(spark, d):
    r = load(spark, d, "msa")
    i = F.col("read_id")
    run = lambda b, k: F.repeat(F.lit(b), (k % 5 + 3).cast("int"))
    seq = F.concat(F.substring("tpl", 1, 40), run("A", i), F.when(i % 11 == 0, "T").otherwise("C"), run("G", F.floor(i / 7)), F.substring("tpl", 41, 96))
    return r.select(i.alias("cluster"), "specimen", (F.col("price") % 997 + 1).alias("size"), (i % 3).cast("int").alias("source"), F.substring(F.lit("ACGT"), (i % 4).cast("int") + 1, F.lit(1)).alias("allele"), seq.alias("seq"))


@query(oracle("select specimen, cluster, into_cluster from classes", _CLUSTERS))
def run_equivalent_clusters(spark, d):
    return merging.equivalence_classes(_clusters(spark, d), "specimen", "cluster", "seq", "size").withColumnRenamed("into", "into_cluster")


@query(oracle("""select specimen, into_cluster as cluster, sum(size)::bigint as size, coalesce(case when count(*) = 1 then any_value(source) end, -1)::int as source, case when count(*) = 1 then any_value(allele) end as allele,
    case when count(*) > 1 then string_agg(concat(source, allele, size), '+' order by size desc, cluster) end as merged_from from classes join clusters using (specimen, cluster) group by specimen, into_cluster""", _CLUSTERS))  # fmt: skip
def merged_equivalent_clusters(spark, d):
    c = _clusters(spark, d)
    m = merging.merged_clusters(c, merging.equivalence_classes(c, "specimen", "cluster", "seq", "size"), "specimen", "cluster", "size", "source", "allele")
    return m.withColumn("source", F.coalesce("source", F.lit(-1))).withColumn("merged_from", F.array_join(F.transform("merged_from", lambda p: F.concat(p["source"].cast("string"), p["allele"], p["size"].cast("string"))), "+"))


#: Amplicons of a read's template with one base replaced: the whole of it, its first 60 bases, its last 60, and its reverse.
_AMPLICONS = """amplicons as (select read_id, specimen, p, (read_id % 4)::int + 1 as grp, read_id % 97 + 1 as size, case read_id % 4 when 0 then s1 when 1 then substr(s1, 1, 60) when 2 then substr(s1, 37) else reverse(s1) end as seq
      from (select *, concat(substr(tpl, 1, p - 1), translate(substr(tpl, p, 1), 'ACGT', 'CATG'), substr(tpl, p + 1)) as s1 from (select read_id, specimen, tpl, (read_id % 11)::int * 8 + 4 as p from g0)))"""


def _amplicons(spark, d):
    r = load(spark, d, "gapped").select("read_id", "specimen", "tpl")
    i = F.col("read_id")
    p = (i % 11).cast("int") * 8 + 4
    s = F.concat(F.substring("tpl", F.lit(1), p - 1), F.translate(F.substring("tpl", p, F.lit(1)), "ACGT", "CATG"), F.substring("tpl", p + 1, F.lit(96)))
    r = r.withColumn("s", s).withColumn("k", i % 4)
    seq = F.when(F.col("k") == 0, F.col("s")).when(F.col("k") == 1, F.substring("s", 1, 60)).when(F.col("k") == 2, F.substring("s", 37, 96)).otherwise(F.reverse("s"))
    primers = F.when(F.col("k") == 0, F.array(F.lit("p1"), F.lit("p4"))).when(F.col("k") == 1, F.array(F.lit("p1"), F.lit("p2"))).when(F.col("k") == 2, F.array(F.lit("p4"), F.lit("p3"))).otherwise(F.array(F.lit("p5")))
    return r.select("read_id", "specimen", "tpl", p.alias("p"), (F.col("k") + 1).cast("int").alias("grp"), (i % 97 + 1).alias("size"), seq.alias("seq"), primers.alias("primers"))


@query(gapped_oracle("""select read_id, round(case when grp = 1 and p > 0 then 1 / 96::double when grp = 2 and p between 4 and 57 then 1 / 60::double when grp = 3 and p between 40 and 93 then 1 / 60::double else 0 end, 9) as distance
    from amplicons where grp < 4 and not (grp = 2 and p between 58 and 60) and not (grp = 3 and p between 37 and 39)""", _AMPLICONS))  # fmt: skip
def overlap_distances(spark, d):
    a = _amplicons(spark, d).where("grp < 4 and not (grp = 2 and p between 58 and 60) and not (grp = 3 and p between 37 and 39)")
    return a.select("read_id", F.round(overlap.overlap_distance(24)(F.col("tpl"), F.col("seq")), 9).alias("distance"))


@query(gapped_oracle("""select distinct specimen, grp, case when grp = 4 then 4 else first(grp) over (partition by specimen, grp = 4 order by anchor desc, grp) end as into_group
    from (select specimen, grp, max(size) as anchor from amplicons group by all)""", _AMPLICONS))
def groups_by_overlap(spark, d):
    a = _amplicons(spark, d)
    links = merging.overlap_links(a, "specimen", "grp", "seq", "primers", 24, 0.9)
    return merging.contracted(a, links, "specimen", "grp", "size").withColumnRenamed("into", "into_group")


@query(gapped_oracle("""select read_id, case when n_subs + n_indels = 0 then 'identical sequences' else concat_ws(', ', case when n_subs > 0 then concat(n_subs, ' substitution', case when n_subs > 1 then 's' else '' end) end,
      case when n_indels > 0 then concat(n_indels, ' single-nt indel', case when n_indels > 1 then 's' else '' end) end) end as summary
    from (select read_id, (p > 0)::int + (hap > 0)::int as n_subs, (d > 0)::int + (q > 0)::int as n_indels from planted join g1 using (read_id))""".replace("planted join g1 using (read_id)", "(select planted.*, g1.p from planted join g1 on planted.read_id = g1.read_id)")))
def variant_summaries(spark, d):
    return load(spark, d, "gapped").select("read_id", overlap.variant_summary("tpl", "seq").alias("summary"))


@query(gapped_oracle("""select specimen, case when merged and (hap = 0 or hap = mate) then least(top, 9) else hap end::bigint as name, any_value(case when merged and (hap = 0 or hap = mate) then both_ else n end)::bigint as size, count(*)::int as n_members,
      max(case when merged and (hap = 0 or hap = mate) then concat(substr(tpl, 1, site - 1), translate(substr(tpl, site, 1), 'ACGT', 'MMKK'), substr(tpl, site + 1)) when hap = 1 then concat(substr(tpl, 1, 19), translate(substr(tpl, 20, 1), 'ACGT', 'CATG'), substr(tpl, 21)) when hap = 2 then concat(substr(tpl, 1, 69), translate(substr(tpl, 70, 1), 'ACGT', 'CATG'), substr(tpl, 71)) else tpl end) as seq
    from (select v.*, mate, mate is not null and n0 is not null as merged, n0 + nm as both_, case when n0 >= nm then 0 else mate end as top, case when mate = 1 then 20 else 70 end as site from v left join (
        select specimen, max(n) filter (hap = 0) as n0, first(hap order by n desc, hap) filter (hap > 0) as mate, max(n) filter (hap > 0) as nm from v group by specimen) using (specimen)) group by 1, 2""",
    "v as (select specimen, hap, any_value(tpl) as tpl, count(*) as n from planted group by all)"))
def merged_variants(spark, d):
    r = load(spark, d, "gapped").groupBy("specimen", "hap").agg(F.first("tpl").alias("tpl"), F.count("*").alias("size"))
    turn = lambda at: F.concat(F.substring("tpl", 1, at - 1), F.translate(F.substring("tpl", at, 1), "ACGT", "CATG"), F.substring("tpl", at + 1, 96))
    v = r.withColumn("seq", F.when(F.col("hap") == 1, turn(20)).when(F.col("hap") == 2, turn(70)).otherwise(F.col("tpl"))).withColumn("name", F.col("hap").cast("long")).withColumn("primers", F.array(F.lit("p1")))
    m = variant_merge.merge_variants(v, ["specimen"], "name", "seq", "size", "size", "primers", variant_merge.Limits(positions=1, floor=1))
    return m.select("specimen", "name", "size", F.size("members").alias("n_members"), "seq")
