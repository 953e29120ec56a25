"""Benchmark passages as the reference, documents as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import kmerset, mapping
from strandloom.plans import fixtures as fx
from strandloom.plans import sql
from strandloom.plans.registry import query
from strandloom.sources import stores
from strandloom.sources.lines import scratch_path

INDEX = f"""with {sql.hits('h', sql.BENCHMARK, fx.DENSE)},
x as materialized (select row_number() over (order by read_id, pos)-1 as loc, kmer, read_id as ref_id, pos as "offset", is_fwd from h),
k as materialized (select kmer, count(*) as depth, case count(*) when 1 then 1 when 2 then 2 else 3 end as copy,
min(loc) as loc1, max(loc) as loc2 from x group by kmer)"""
SEEDS = f"""{INDEX}, {sql.hits('q', sql.DOCUMENTS, fx.DENSE)},
s as materialized (select q.*, k.copy, k.loc1, case when k.copy=2 then k.loc2 end as loc2 from q left join k on q.kmer=k.kmer)"""


@query("ref_index", f'{INDEX} select loc, kmer, ref_id, "offset", is_fwd from x')
def ref_index(spark, sf_dir):
    return mapping.index_reference(fx.benchmark(spark, sf_dir), fx.DENSE)


def _reference(spark, sf_dir):
    return mapping.reference_kmers(ref_index(spark, sf_dir))


@query("ref_copy", f"{INDEX} select copy, count(*) as n_kmers, sum(depth)::bigint as n_hits from k group by copy")
def ref_copy(spark, sf_dir):
    return mapping.copy_class_counts(_reference(spark, sf_dir))


def _seeds(spark, sf_dir):
    return mapping.query_seeds(fx.documents(spark, sf_dir), _reference(spark, sf_dir), fx.DENSE)


SUMMARY = f"""{SEEDS}, l as (select read_id, length(seq) as len from ({sql.DOCUMENTS})),
g as (select read_id, count(*) as n, count(copy) as f, count(case when copy=1 then 1 end) as c1,
count(case when copy=2 then 1 end) as c2, count(case when copy=3 then 1 end) as c3 from s group by read_id)
select l.read_id, len, coalesce(n-f,0) as n_miss, coalesce(c1,0) as n_copy1, coalesce(c2,0) as n_copy2, coalesce(c3,0) as n_multi,
f::double/n as hit_fraction from l left join g on l.read_id=g.read_id"""


@query("query_summary", SUMMARY)
def query_summary(spark, sf_dir):
    return mapping.query_summary(fx.documents(spark, sf_dir), _seeds(spark, sf_dir))


def _stored_reference(spark, sf_dir):
    path = scratch_path(spark, "reference")
    refs = fx.benchmark(spark, sf_dir)
    names = fx.clean(refs).select("read_id", F.concat(F.lit("item"), "read_id").alias("name"), "len")
    stores.write_reference(ref_index(spark, sf_dir), names, fx.DENSE, path)
    return path


@query(
    "reference_roundtrip",
    f"""{INDEX}, n as (select read_id, 'item' || read_id as name, length(seq) as len from ({sql.BENCHMARK}))
select x.loc, x.kmer, x.ref_id, n.name, n.len, x."offset", x.is_fwd, k.depth, k.copy, k.loc1, case when k.copy=2 then k.loc2 end as loc2
from x join n on x.ref_id=n.read_id join k on x.kmer=k.kmer""",
)
def reference_roundtrip(spark, sf_dir):
    """A stored reference read back: every occurrence with its sequence's name and its k-mer's places."""
    path = _stored_reference(spark, sf_dir)
    index, names, _ = stores.read_reference(spark, path)
    kmers = stores.read_reference_kmers(spark, path).select("kmer", "depth", "copy", F.col("first.loc").alias("loc1"), F.col("second.loc").alias("loc2"))
    return index.join(names.withColumnRenamed("read_id", "ref_id"), "ref_id").join(kmers, "kmer")


@query("map_from_store", SUMMARY)
def map_from_store(spark, sf_dir):
    """Queries looked up in a stored reference, whose k-mers are not shuffled again."""
    path = _stored_reference(spark, sf_dir)
    _, _, params = stores.read_reference(spark, path)
    queries = fx.documents(spark, sf_dir)
    return mapping.query_summary(queries, mapping.query_seeds(queries, stores.read_reference_kmers(spark, path), params, kept=True))


@query(
    "seed_hits",
    f"""{SEEDS}, p as (select read_id, ord, pos, kmer, copy, 0 as place, loc1 as loc from s where copy<3
union all select read_id, ord, pos, kmer, copy, 1, loc2 from s where copy=2)
select p.read_id, p.ord, p.pos, p.kmer, p.copy, p.place, x.ref_id, x."offset", p.loc from p join x on p.loc=x.loc""",
)
def seed_hits(spark, sf_dir):
    return mapping.seed_places(_seeds(spark, sf_dir))


@query(
    "refpaint",
    f"""with {sql.hits('h', sql.BENCHMARK, fx.DENSE)}, {sql.hits('d', sql.DOCUMENTS, fx.DENSE)},
t as (select kmer, least(count(*),65535)::integer as depth from d group by kmer)
select h.read_id, h.pos, t.depth from h join t on h.kmer=t.kmer""",
)
def refpaint(spark, sf_dir):
    table = kmerset.count_kmers(fx.documents(spark, sf_dir), fx.DENSE)
    return mapping.paint(fx.benchmark(spark, sf_dir), table, fx.DENSE)


def _breaks(loc: str, ref: str) -> str:
    return f"""({ref}<>f.r0 or (f.loc0<f.locn and {loc}<f.locn) or (f.loc0>f.locn and {loc}>f.locn)
 or (f.loc0<>f.locn and abs(abs(f.locn-f.loc0)-(f.inn-f.i0))>50))"""


@query(
    "map_query_blocks",
    f"""{SEEDS.replace("with", "with recursive", 1)}, u as materialized (select s.read_id, s.ord, s.pos, s.copy, s.loc1, s.loc2, a.ref_id as r1, b.ref_id as r2,
row_number() over (partition by s.read_id order by s.ord) as n, count(case when copy=1 then 1 end) over (partition by s.read_id) as singles,
count(*) over (partition by s.read_id) as total
from s join x a on s.loc1=a.loc left join x b on s.loc2=b.loc where copy<3),
f as (
 select read_id, n, total, singles, 0::bigint as loc0, 0::bigint as r0, 0::bigint as locn, 0 as i0, 0 as q0, 0 as inn, 0 as qn, 0 as n1, 0 as n2,
 null::bigint as d0, null::bigint as dn, null::integer as e0, null::integer as en, null::integer as m1, null::integer as m2
 from (select distinct read_id, 0::bigint as n, total, singles from u)
 union all
 select read_id, n, total, singles, case when ends then loc else loc0 end, case when ends then ref else r0 end, loc,
 case when ends then ord else i0 end, case when ends then pos else q0 end, ord, pos,
 (case when ends then 0 else n1 end)+(case when copy=1 then 1 else 0 end), (case when ends then 0 else n2 end)+(case when copy=2 then 1 else 0 end),
 case when ends and n1>2 then loc0 end, locn, q0, qn, n1, n2
 from (select f.loc0, f.r0, f.locn, f.i0, f.q0, f.qn, f.n1, f.n2, u.*,
   case when f.loc0=0 or not {_breaks('u.loc1', 'u.r1')} or u.copy=1 then u.loc1 else u.loc2 end as loc,
   case when f.loc0=0 or not {_breaks('u.loc1', 'u.r1')} or u.copy=1 then u.r1 else u.r2 end as ref,
   case when f.loc0=0 then true when not {_breaks('u.loc1', 'u.r1')} then false when u.copy=1 then true
        else {_breaks('u.loc2', 'u.r2')} end as ends
   from f join u on u.read_id=f.read_id and u.n=f.n+1)),
b as (select read_id, singles, d0 as loc0, dn as locn, e0 as q0, en as qn, m1 as n1, m2 as n2 from f where d0 is not null
 union all select read_id, singles, loc0, locn, q0, qn, n1, n2 from f where n=total and n1>2)
select b.read_id, q0 as query_start, qn as query_end, qn-q0 as span, a.ref_id, a."offset" as ref_start, z."offset" as ref_end,
n1, n2, case when loc0<>locn then (n1+n2)::double/abs(locn-loc0) end as density, n1::double/singles as single_fraction
from b join x a on a.loc=b.loc0 join x z on z.loc=b.locn""",
)
def map_query_blocks(spark, sf_dir):
    return mapping.chain_blocks(_seeds(spark, sf_dir))
