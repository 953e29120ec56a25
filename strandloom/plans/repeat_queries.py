"""Documents over the page texts as repeat unit.

The page k-mers that occur once stand for the unit; a read is used when its first
6 hits to them favour one strand (at most 2 votes for the other, or for this one).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import kmerset, repeats
from strandloom.plans import fixtures as fx
from strandloom.plans import sql
from strandloom.plans.registry import query
from strandloom.session import checkpointed

FIRST, TOLERANCE = 6, 2
K = fx.DENSE.k
VOTES = f"""with recursive {sql.hits('d', sql.DOCUMENTS, fx.DENSE)}, {sql.hits('g', sql.PAGES, fx.DENSE)},
ref as materialized (select kmer, any_value(is_fwd) as ref_fwd, any_value(pos) as pos from g group by kmer having count(*)=1),
rk as (select d.read_id, d.is_fwd=ref.ref_fwd as same, row_number() over (partition by d.read_id order by d.pos) as rn from d join ref on d.kmer=ref.kmer),
vt as (select read_id, count(case when same then 1 end) as f, count(case when not same then 1 end) as r from rk where rn<={FIRST} group by read_id),
rl as materialized (select read_id, length(seq) as len from ({sql.DOCUMENTS})),
votes as materialized (select rl.read_id, len, coalesce(f,0) as n_fwd, coalesce(r,0) as n_rev,
 coalesce(f,0)+coalesce(r,0)<{FIRST} or (coalesce(f,0)>{TOLERANCE} and coalesce(r,0)>{TOLERANCE}) as is_bad, coalesce(f,0)>=coalesce(r,0) as is_forward
 from rl left join vt on rl.read_id=vt.read_id)"""
HITS0 = f"""{VOTES}, tb as materialized (select distinct kmer from d),
h0 as materialized (select d.read_id, d.kmer, case when is_forward then pos else (d.len-{K}-pos)::integer end as x
 from d join tb on d.kmer=tb.kmer join votes v on v.read_id=d.read_id and not v.is_bad),
nr as materialized (select count(*) as n from votes where not is_bad)"""


def _cleaned(name: str, source: str, counted: str, reads: str) -> str:
    """CTEs: ``m{name}`` usable k-mers of ``counted`` and ``h{name}`` hits of ``source`` in them."""
    return f"""m{name} as materialized (select kmer, n from ({counted}) where n>=5 and n<=(select n//2 from {reads})),
h{name} as materialized (select * from {source} where kmer in (select kmer from m{name}))"""


def _counted(source: str) -> str:
    return f"select kmer, count(*) as n from {source} group by kmer"


def _links(name: str, source: str) -> str:
    return f"""p{name} as materialized (select * from (select read_id, lag(kmer) over w as k0, kmer as k1, x-lag(x) over w as dx from {source}
 window w as (partition by read_id order by x)) where k0 is not null),
a{name} as materialized (select k0, k1, count(*) as n, sum(dx)::bigint as sum_dx from p{name} group by k0, k1)"""


def _informative(name: str, mods: str, links: str) -> str:
    return f"""i{name} as materialized (select m.kmer, m.n from {mods} m join (
 select m.kmer, bool_or(s.n>=5 and (s.n>m.n//2 or s.n>s.other//2)) as ok, bool_or(is_pre and s.n=m.n and s.n=s.other) as red from {mods} m join (
  select k1 as kmer, n, sum(n) over (partition by k0) as other, true as is_pre from {links}
  union all select k0, n, sum(n) over (partition by k1), false from {links}) s on s.kmer=m.kmer group by m.kmer) v on v.kmer=m.kmer where ok and not red)"""


CLEAN1 = f"{HITS0}, {_cleaned('1', 'h0', _counted('h0'), 'nr')}"
THINNED = f"""{CLEAN1}, ix as materialized (select *, row_number() over (partition by read_id order by x) as i from h1),
nx as materialized (select a.read_id, a.i, b.i as j from ix a asof left join ix b on a.read_id=b.read_id and b.x>=a.x+{K}),
nl as materialized (select read_id, list(j order by i) as js from nx group by read_id),
walk as (select read_id, 1::bigint as i from nl union all select w.read_id, js[w.i] from walk w join nl using (read_id) where js[w.i] is not null),
h2 as materialized (select ix.read_id, ix.kmer, ix.x from ix join walk on walk.read_id=ix.read_id and walk.i=ix.i)"""
CLEAN3 = f"{THINNED}, {_cleaned('3', 'h2', _counted('h2'), 'nr')}, {_links('3', 'h3')}"
INFORMED = f"""{CLEAN3}, {_informative('4', 'm3', 'a3')}, h4 as materialized (select * from h3 where kmer in (select kmer from i4)), {_links('4', 'h4')},
weak as materialized (select distinct read_id from p4 where (k0,k1) in (select (k0,k1) from a4 where n<5))"""
FINAL = f"""{INFORMED}, gr as materialized (select read_id from votes where not is_bad and read_id not in (select read_id from weak)),
ng as materialized (select count(*) as n from gr), h5 as materialized (select * from h4 where read_id not in (select read_id from weak)),
h5n as (select *, lead(x) over (partition by read_id order by x) as nextx from h5),
{_cleaned('6', 'h5', "select kmer, count(*) as n from h5n where nextx is not null group by kmer", 'ng')}, {_links('6', 'h6')},
{_informative('7', 'm6', 'a6')}, h7 as materialized (select * from h6 where kmer in (select kmer from i7)), {_links('7', 'h7')}"""


def _votes(spark, sf_dir):
    reference = repeats.reference_kmers(fx.pages(spark, sf_dir), fx.DENSE)
    return repeats.strand_vote(fx.documents(spark, sf_dir), reference, fx.DENSE, FIRST, TOLERANCE)


def _table(spark, sf_dir):
    return kmerset.count_kmers(fx.documents(spark, sf_dir), fx.DENSE)


def _hits(spark, sf_dir):
    votes = checkpointed(_votes(spark, sf_dir))
    hits = repeats.oriented_hits(fx.documents(spark, sf_dir), votes, _table(spark, sf_dir), fx.DENSE)
    return votes, checkpointed(hits)


def _clean(spark, sf_dir):
    votes, hits = _hits(spark, sf_dir)
    n_reads = votes.where("not is_bad").count()
    return repeats.usable_mods(repeats.count_mods(hits), n_reads), hits, n_reads


def _thinned(spark, sf_dir):
    mods, hits, n_reads = _clean(spark, sf_dir)
    thin = checkpointed(repeats.thin_hits(repeats.keep_mods(hits, mods), fx.DENSE.k))
    usable = checkpointed(repeats.usable_mods(repeats.count_mods(thin), n_reads))
    return usable, checkpointed(repeats.keep_mods(thin, usable))


def _analysis(spark, sf_dir):
    reads = fx.documents(spark, sf_dir)
    return repeats.analyse(reads, checkpointed(_votes(spark, sf_dir)), _table(spark, sf_dir), fx.DENSE)


@query("rep_reference", f"{VOTES} select kmer, ref_fwd as is_fwd, pos from ref")
def rep_reference(spark, sf_dir):
    return repeats.reference_kmers(fx.pages(spark, sf_dir), fx.DENSE)


@query("strand_vote", f"{VOTES} select * from votes")
def strand_vote(spark, sf_dir):
    return _votes(spark, sf_dir)


@query("rep_hits", f"{HITS0} select read_id, kmer, x from h0")
def rep_hits(spark, sf_dir):
    return _hits(spark, sf_dir)[1]


@query("rep_clean_mods", f"{CLEAN1} select kmer, n from m1")
def rep_clean_mods(spark, sf_dir):
    return _clean(spark, sf_dir)[0]


@query("thin_hits", f"{THINNED} select read_id, kmer, x from h2")
def thin_hits(spark, sf_dir):
    mods, hits, _ = _clean(spark, sf_dir)
    return repeats.thin_hits(repeats.keep_mods(hits, mods), fx.DENSE.k)


@query("adjacency", f"{CLEAN3} select k0, k1, n, sum_dx from a3")
def adjacency(spark, sf_dir):
    return repeats.adjacency(_thinned(spark, sf_dir)[1])


@query(
    "adjacency_mode",
    f"""{CLEAN3}, sd as (select k0 as kmer, 'post' as side, k1 as other, n, sum_dx from a3 union all select k1, 'pre', k0, n, sum_dx from a3),
rn as (select *, sum(n) over (partition by kmer, side)::bigint as n_links, count(*) over (partition by kmer, side) as n_neighbours,
row_number() over (partition by kmer, side order by n desc, other) as rn from sd)
select kmer, side, n_links, n_neighbours, other, n, sum_dx//n as mean_dx from rn where rn=1""",
)
def adjacency_mode(spark, sf_dir):
    return repeats.commonest_neighbour(repeats.adjacency(_thinned(spark, sf_dir)[1]))


@query("rep_bad_mods", f"{INFORMED} select kmer, n from m3 where kmer not in (select kmer from i4)")
def rep_bad_mods(spark, sf_dir):
    mods, hits = _thinned(spark, sf_dir)
    return mods.join(repeats.informative_mods(mods, repeats.adjacency(hits)), "kmer", "left_anti")


@query("rep_weak_reads", f"{INFORMED} select read_id from weak")
def rep_weak_reads(spark, sf_dir):
    mods, hits = _thinned(spark, sf_dir)
    kept = repeats.informative_mods(mods, repeats.adjacency(hits))
    return repeats.weak_reads(repeats.keep_mods(hits, kept))


@query("rep_mods", f"{FINAL} select kmer, n from i7")
def rep_mods(spark, sf_dir):
    return _analysis(spark, sf_dir)["mods"]


@query("rep_links", f"{FINAL} select k0, k1, n, sum_dx from a7")
def rep_links(spark, sf_dir):
    return _analysis(spark, sf_dir)["links"]


@query(
    "rep_blocks",
    f"""{FINAL}, ls as (select gr.read_id, coalesce(l.kmers, []::bigint[]) as kmers from gr left join (select read_id, list(kmer order by x) as kmers from h7 group by read_id) l on l.read_id=gr.read_id)
select kmers, count(*) as n_reads, min(read_id) as first_read, len(kmers)::integer as n_mods from ls group by kmers""",
)
def rep_blocks(spark, sf_dir):
    found = _analysis(spark, sf_dir)
    return repeats.read_blocks(found["reads"], found["hits"])


@query(
    "rep_minmax",
    f"""{HITS0}, pr as (select kmer, read_id, count(*) as n from h0 group by all), pk as materialized (select kmer, sum(n) as n, sum(n-1) as n_dup from pr group by kmer),
dp as (select h0.read_id, max(pk.n) as deep from h0 left join pk on pk.kmer=h0.kmer and n_dup=0 group by h0.read_id)
select 'n_reads' as metric, (select count(*)::double from votes) as value union all select 'n_bad', (select count(*) from votes where is_bad)
union all select 'n_good', (select n from nr) union all select 'n_mods', (select count(*) from tb)
union all select 'n_dup', (select count(*) from pk where n_dup>0) union all select 'mean_dup', (select sum(n_dup)::double/nullif(count(case when n_dup>0 then 1 end),0) from pk)
union all select 'min_max', (select min(deep) from dp)""",
)
def rep_minmax(spark, sf_dir):
    votes, hits = _hits(spark, sf_dir)
    return repeats.duplicate_summary(votes, hits, _table(spark, sf_dir))


@query(
    "boundary_cooccur",
    f"""{VOTES}, top as (select kmer from (select d.kmer, count(*) as n from d join ref on ref.kmer=d.kmer group by d.kmer order by n desc, d.kmer limit 4)),
bd as (select kmer, row_number() over (order by kmer)-1 as i from top),
hb as (select read_id, bool_or(i=0) as b0, bool_or(i=1) as b1, bool_or(i=2) as b2, bool_or(i=3) as b3 from d join bd on bd.kmer=d.kmer group by read_id)
select count(case when b0 and b1 then 1 end) as n1, count(case when b1 and b2 then 1 end) as n2, count(case when b2 and b3 then 1 end) as n3, count(case when b3 and b0 then 1 end) as n4 from hb""",
)
def boundary_cooccur(spark, sf_dir):
    """The four boundaries are the reference k-mers most frequent in the documents."""
    reads = fx.documents(spark, sf_dir)
    reference = repeats.reference_kmers(fx.pages(spark, sf_dir), fx.DENSE)
    common = kmerset.count_kmers(reads, fx.DENSE).join(reference.select("kmer"), "kmer", "left_semi")
    rows = common.orderBy(F.desc("depth"), "kmer").limit(4).collect()
    return repeats.boundary_cooccurrence(reads, sorted(row.kmer for row in rows), fx.DENSE)
