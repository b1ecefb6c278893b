"""Queries on validation and reading order, with SQL that solves for the critical rate by bisection over sums of binomial terms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tree, validation
from .derived import CELLS, gapped_oracle, load, oracle
from .queries import ORACLE, RATES, query

#: From (id, n, m, goal): log_q, at which ln P(Bin(n, q) >= m) = goal; infinite if none below 1 reaches it.
_SOLVED = """ways as (select distinct n, m, goal from asked),
      bis as (select n, m, goal, -600.0::double as lo, 0.0::double as hi, 0 as it from ways union all
              select n, m, goal, case when t < goal then mid else lo end, case when t < goal then hi else mid end, it + 1 from (
                select *, list_max(terms) + ln(list_sum([exp(x - list_max(terms)) for x in terms])) as t from (
                  select *, [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * mid + (n - k) * ln(1 - exp(mid)) for k in range(m, n + 1)] as terms from (select *, (lo + hi) / 2 as mid from bis where it < 60)))),
      solved as (select n, m, goal, (lo + hi) / 2 as log_q from bis where it = 60)"""

_PEERS = f"""vs as (select specimen, hap as name, count(*) as size from planted group by all),
      placed as (select *, sum(size) over (partition by specimen)::bigint as n, row_number() over (partition by specimen order by size desc, name) as place from vs),
      pairs as (select a.specimen, a.name, a.n, a.size as m, b.name as peer, b.place as peer_place, (a.name > 0)::int + (b.name > 0)::int as k from placed a join placed b on a.specimen = b.specimen and b.place < a.place),
      asked as (select *, ln(1e-5::double) - (lgamma(97) - lgamma(k + 1) - lgamma(97 - k)) as goal from pairs),
      {_SOLVED},
      factors as (select specimen, name, exp((log_q - k * ln({RATES["non-hp-sub"]})) / k) as f, exp(log_q / k) as p, k, peer, peer_place from asked join solved using (n, m, goal))"""


@query(gapped_oracle("""select specimen, name, round(f, 5) as cer_factor, round(p, 8) as cer_pstar, coalesce(k, 0)::bigint as k, coalesce(peer, -1)::int as peer from placed left join (
    select specimen, name, f, p, k, peer, row_number() over (partition by specimen, name order by f, peer_place) as r from factors) using (specimen, name) where coalesce(r, 1) = 1""", _PEERS))  # fmt: skip
def validated_variants(spark, d):
    r = load(spark, d, "gapped").groupBy("specimen", "hap").agg(F.first("tpl").alias("tpl"), F.count("*").alias("size"))
    turn = lambda at: F.concat(F.substring("tpl", 1, at - 1), F.translate(F.substring("tpl", at, 1), "ACGT", "CATG"), F.substring("tpl", at + 1, 96))
    v = r.withColumn("seq", F.when(F.col("hap") == 1, turn(20)).when(F.col("hap") == 2, turn(70)).otherwise(F.col("tpl")))
    x = validation.validated(v, ["specimen"], "hap", "seq", "size", RATES)
    return x.select("specimen", "name", F.round("cer_factor", 5).alias("cer_factor"), F.round("cer_pstar", 8).alias("cer_pstar"), F.coalesce("k", F.lit(0)).cast("long").alias("k"), F.coalesce("peer", F.lit(-1)).cast("int").alias("peer"))


#: Trees as deep as they come: a variant hangs on one of the four before it.
_TREE = """tv as (select specimen, ordinal, size, row_number() over (partition by specimen order by size desc, ordinal)::bigint as p from variants),
      te as (select a.specimen, a.ordinal, a.size, b.ordinal as parent from tv a left join tv b on a.specimen = b.specimen and b.p = greatest(a.p - 1 - a.ordinal % 4, 1) and a.p > 1),
      ts as (select *, row_number() over (partition by specimen, parent order by size desc, ordinal) as k, count(*) over (partition by specimen, parent) as n from te),
      walk as (select specimen, ordinal, [k] as path, '' as bars, '' as lead from ts where parent is null union all
               select ts.specimen, ts.ordinal, list_append(path, ts.k), case when ts.k = ts.n then concat(bars, '   ') else concat(bars, '│  ') end, concat(bars, case when ts.k = ts.n then '└─ ' else '├─ ' end) from walk join ts on ts.specimen = walk.specimen and ts.parent = walk.ordinal)"""


@query(oracle("select specimen, ordinal, len(path)::int - 1 as depth, row_number() over (partition by specimen order by path)::int as place, lead from walk", _TREE))
def variant_tree(spark, d):
    v = load(spark, d, "variants").select("specimen", "ordinal", "size").withColumn("p", F.row_number().over(Window.partitionBy("specimen").orderBy(F.desc("size"), "ordinal")).cast("long"))
    up = v.select("specimen", F.col("p").alias("q"), F.col("ordinal").alias("parent"))
    e = v.withColumn("q", F.when(F.col("p") > 1, F.greatest(F.col("p") - 1 - F.col("ordinal") % 4, F.lit(1)))).join(up, ["specimen", "q"], "left")
    return tree.reading_order(e, ["specimen"], "ordinal", "parent", "size")


# the SQL of a query whose rows were not held against anything before
ORACLE["variant_significance"] = oracle(
    f"select specimen, pos, base, found.n, total, round(log_q, 6) as log_q, round(exp(log_q - ln({RATES['non-hp-sub']})), 6) as cer_factor from found join solved using (n, m, goal)".replace("using (n, m, goal)", "on solved.n = found.total and solved.m = found.n"),
    CELLS, "found as (select specimen, pos, base, n, total from ranked where r > 1 and n >= 3)", "asked as (select distinct total::bigint as n, n::bigint as m, ln(1e-5::double) - ln(96) as goal from found)", _SOLVED,
)
