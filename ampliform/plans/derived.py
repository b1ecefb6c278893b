"""Aligned reads and variants derived from the orders table, by the same SQL in Spark and in DuckDB.

A specimen is a customer class with a template of 96 bases; reads are its orders, in three haplotypes (6, 3 and 1 of 10),
each with at most one substituted and one missing base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LETTERS = "'0123456789abcdef','ACGTACGTACGTACGT'"


def msa_sql(string: str) -> str:
    tpl = ", ".join(f"md5(concat('{c}', cast(o_custkey % 50 as {string})))" for c in "abc")
    return f"""
      t as (select o_orderkey as read_id, o_custkey % 50 as specimen, o_custkey as donor, case when o_orderkey % 10 < 6 then 0 when o_orderkey % 10 < 9 then 1 else 2 end as hap,
                   cast(o_orderkey % 131 as int) + 1 as p, substr('ACGT', cast(o_orderkey % 4 as int) + 1, 1) as b, cast(o_orderkey % 149 as int) + 1 as d,
                   translate(concat({tpl}), {_LETTERS}) as tpl, cast(floor(o_totalprice) as bigint) as price from orders),
      h as (select *, case when hap = 1 then concat(substr(tpl, 1, 19), translate(substr(tpl, 20, 1), 'ACGT', 'GTAC'), substr(tpl, 21))
                           when hap = 2 then concat(substr(tpl, 1, 69), translate(substr(tpl, 70, 1), 'ACGT', 'CATG'), substr(tpl, 71)) else tpl end as s0 from t),
      e as (select *, case when p <= 96 then concat(substr(s0, 1, p - 1), b, substr(s0, p + 1)) else s0 end as s1 from h),
      msa as (select read_id, specimen, donor, hap, tpl, price, case when d <= 96 then concat(substr(s1, 1, d - 1), '-', substr(s1, d + 1)) else s1 end as row_aln from e),
      reads as (select read_id, specimen, donor, hap, tpl, price, row_aln, replace(row_aln, '-', '') as seq,
                       substr(translate(concat(md5(cast(read_id as {string})), md5(concat('q', cast(read_id as {string})))), '0123456789abcdef', '+-/13579;=?ACEGI'), 1, 40) as qual from msa),
      variants as (select read_id as ordinal, read_id % 400 as specimen, cast(read_id % 4 as int) as grp, price % 997 + 1 as size, least(price % 997 + 1, 100) as ric,
                          case when read_id % 5 = 0 then null else (read_id % 41) / 20.0 end as cer_factor, case when read_id % 7 = 0 then null else (read_id % 37) / 20.0 end as err_factor,
                          case when read_id % 29 = 0 then concat('1.v', cast(read_id % 3 + 1 as {string})) end as chimera, replace(row_aln, '-', '') as seq from msa)"""


def gapped_sql(string: str) -> str:
    """Reads with a base too many, one missing and one replaced, of which one alignment is best: A and C take turns with G and T, so no run
    blurs where a base is missing, and errors keep twelve columns apart. ``planted`` has the places, ``gapped`` the reads."""
    swap = lambda x, at: f"concat(substr({x}, 1, {at} - 1), translate(substr({x}, {at}, 1), 'ACGT', 'CATG'), substr({x}, {at} + 1))"
    far = lambda a, *others: " and ".join([f"{a} between 2 and 94", *(f"abs({a} - {o}) >= 12" for o in others)])
    digits = f"translate(substr(concat(md5(concat('u', cast(o_custkey % 50 as {string}))), md5(concat('v', cast(o_custkey % 50 as {string})))), 1, 48), '0123456789abcdef', 'wxyzwxyzwxyzwxyz')"
    return f"""
      g0 as (select o_orderkey as read_id, o_custkey % 50 as specimen, case when o_orderkey % 10 < 6 then 0 when o_orderkey % 10 < 9 then 1 else 2 end as hap,
                    cast(o_orderkey % 131 as int) + 1 as p0, cast(o_orderkey % 149 as int) + 1 as d0, cast(o_orderkey % 113 as int) + 1 as q0,
                    replace(replace(replace(replace({digits}, 'w', 'AG'), 'x', 'AT'), 'y', 'CG'), 'z', 'CT') as tpl from orders),
      g1 as (select *, case when hap = 1 then {swap("tpl", 20)} when hap = 2 then {swap("tpl", 70)} else tpl end as s0, case when {far("p0", 20, 70)} then p0 else 0 end as p from g0),
      g2 as (select *, case when {far("d0", 20, 70, "p")} then d0 else 0 end as d, case when p > 0 then {swap("s0", "p")} else s0 end as s1 from g1),
      planted as (select read_id, specimen, hap, tpl, s1, d, case when {far("q0", 20, 70, "p", "d")} then q0 else 0 end as q from g2),
      gapped as (select read_id, specimen, hap, tpl, case when q > d and d > 0 then concat(substr(s1, 1, d - 1), substr(s1, d + 1, q - d), extra, substr(s1, q + 1)) when d > 0 and q > 0 then concat(substr(s1, 1, q), extra, substr(s1, q + 1, d - q - 1), substr(s1, d + 1))
                        when d > 0 then concat(substr(s1, 1, d - 1), substr(s1, d + 1)) when q > 0 then concat(substr(s1, 1, q), extra, substr(s1, q + 1)) else s1 end as seq
                 from (select *, translate(substr(s1, greatest(q, 1), 1), 'ACGT', 'CATG') as extra from planted))"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of msa, reads, variants and gapped over the orders of ``sf_dir``; only the columns that they need are read."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    return spark.sql(f"with orders as (select * from {{o}}), {gapped_sql('string') if name == 'gapped' else msa_sql('string')} select * from {name}", o=orders)


#: Positional counts for the DuckDB side.
CELLS = """cells as (select specimen, read_id, i - 1 as pos, substr(row_aln, i, 1) as base from msa, (select unnest(range(1, 97)) as i)),
      comp as (select specimen, pos, base, count(*) as n from cells group by all),
      ranked as (select *, sum(n) over (partition by specimen, pos) as total, row_number() over (partition by specimen, pos order by n desc, instr('ACGT-', base)) as r from comp)"""


#: The columns that the gapped reads have in common: a column for each base of the template, and one for each place where any read has a base more.
GAPPED = """gc as (select specimen, read_id, hap, 2 * i as s, case when i = d then '-' else substr(s1, i, 1) end as base from planted, (select unnest(range(1, 97))::int as i)),
      extra as (select specimen, read_id, 2 * q + 1 as s, translate(substr(s1, q, 1), 'ACGT', 'CATG') as base from planted where q > 0),
      slots as (select distinct specimen, s from extra),
      gcells0 as (select specimen, read_id, s, base from gc union all
                  select p.specimen, p.read_id, slots.s, coalesce(extra.base, '-') from planted p join slots on p.specimen = slots.specimen left join extra on extra.read_id = p.read_id and extra.s = slots.s),
      live as (select specimen, s, (row_number() over (partition by specimen order by s) - 1)::int as pos from (select specimen, s from gcells0 group by all having count_if(base <> '-') > 0)),
      gcells as (select specimen, read_id, pos, base from gcells0 join live using (specimen, s)),
      gcomp as (select specimen, pos, base, count(*) as n from gcells group by all)"""


def gapped_oracle(body: str, *ctes: str) -> str:
    """SQL for DuckDB over the gapped reads and their planted columns."""
    return "with recursive " + ",\n".join([gapped_sql("varchar"), GAPPED, *ctes]) + "\n" + body


def oracle(body: str, *ctes: str) -> str:
    """SQL for DuckDB over the derived tables: further named queries, then the body."""
    return "with recursive " + ",\n".join([msa_sql("varchar"), *ctes]) + "\n" + body
