"""Document k-mers placed against the page texts as repeat reference.

Depth over 2 is core, over 50 multi; stretches run between the 10th core hits.
Anchors of the linkage test have depth in [3, 20).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from strandloom.operators import linkage, readset
from strandloom.plans import fixtures as fx
from strandloom.plans import sql
from strandloom.plans.readset_queries import FLAGS, HITS, load
from strandloom.plans.registry import query
from strandloom.session import checkpointed, discard, passing_shuffles, stored

CORE, MULTI, NTH, LOW, HIGH = 2, 50, 10, 3, 20
KIND = f"case when depth>{MULTI} then 'multi' when depth>{CORE} then 'core' else 'var' end"
MARKS = f"""{HITS}, {FLAGS}, {sql.hits('r', sql.PAGES, fx.DENSE)},
lastpos as materialized (select kmer, arg_max(pos, read_id*1000000+pos) as pos from r group by kmer),
tf as materialized (select t.kmer, t.depth, info | case when is_repeat then 8 else 0 end | case when is_internal then 16 else 0 end | case when is_minor then 4 else 0 end as info
 from t left join f on t.kmer=f.kmer),
mk as materialized (select tf.kmer, depth, info | case when l.kmer is not null then 32 else 0 end as info, l.kmer is not null as in_ref,
 case when l.kmer is not null then {KIND} end as kind, l.pos as ref_pos from tf left join lastpos l on tf.kmer=l.kmer)"""
COVERED = f"""{MARKS}, ah as materialized (select h.read_id, h.kmer, h.pos, mk.in_ref, mk.ref_pos, mk.in_ref and mk.kind='core' as anchor from h join mk on h.kmer=mk.kmer),
ac as materialized (select *, sum(anchor::int) over (partition by read_id order by pos) as fl, sum(anchor::int) over (partition by read_id) as tot from ah),
ab as materialized (select *, min(case when anchor and fl={NTH} then pos end) over (partition by read_id) as la,
 min(case when anchor and tot-fl+1={NTH} then pos end) over (partition by read_id) as ra from ac),
cv as materialized (select read_id, kmer, pos, in_ref,
 coalesce(last_value(case when in_ref then ref_pos end ignore nulls) over (partition by read_id order by pos rows unbounded preceding),0) as last_ref_pos
 from ab where pos>=la and pos<ra)"""
INFERRED = f"""{COVERED}, se as (select kmer, count(*) as n, min(last_ref_pos) as lo, max(last_ref_pos) as hi, (sum(last_ref_pos)//count(*))::integer as mean
 from cv where not in_ref group by kmer),
inf as materialized (select kmer, case when n=1 then lo when mean>0 and hi-mean<50 and mean-lo<50 then mean else -1 end as p from se),
mi as materialized (select mk.kmer, depth, info | case when inf.kmer is not null then 32 else 0 end as info, in_ref,
 case when inf.kmer is not null then {KIND} else kind end as kind, coalesce(inf.p, ref_pos) as ref_pos from mk left join inf on mk.kmer=inf.kmer)"""


def _flagged(spark, sf_dir):
    """Readset with repeat, internal and minor bits set in the table; the seeds, which only tell hits from misses from here on,
    are not looked up again."""
    seeds = readset.sampled(fx.documents(spark, sf_dir), fx.DENSE)
    loaded = load(spark, sf_dir, seeds).materialized()
    discard(seeds)
    return replace(loaded, table=stored(readset.apply_flags(loaded.table, readset.kmer_flags(loaded)), "read-kmers"))


def _marks(spark, sf_dir, loaded):
    return linkage.mark_reference(loaded, fx.pages(spark, sf_dir), CORE, MULTI)


def _inferred(spark, sf_dir, loaded):
    marks = checkpointed(_marks(spark, sf_dir, loaded))
    return linkage.infer_positions(marks, linkage.covered_hits(loaded, marks, NTH), CORE, MULTI)


@query("ref_flag", f"{MARKS} select kmer, depth, info, in_ref, kind, ref_pos from mk")
def ref_flag(spark, sf_dir):
    return _marks(spark, sf_dir, _flagged(spark, sf_dir))


@query("repeat_read_hits", f"{COVERED} select read_id, kmer, pos, in_ref, last_ref_pos from cv")
def repeat_read_hits(spark, sf_dir):
    loaded = _flagged(spark, sf_dir)
    return linkage.covered_hits(loaded, _marks(spark, sf_dir, loaded), NTH)


@query("infer_ref_pos", f"{INFERRED} select kmer, depth, info, in_ref, kind, ref_pos from mi")
def infer_ref_pos(spark, sf_dir):
    return _inferred(spark, sf_dir, _flagged(spark, sf_dir))


@query(
    "ref_flag_summary",
    f"""{INFERRED} select in_ref, case when kind<>'var' then kind when info&3>0 then 'var_copied' else 'var_copy0' end as class,
count(*) as n_kmers, count(case when ref_pos>0 then 1 end) as n_placed from mi where kind is not null group by all""",
)
def ref_flag_summary(spark, sf_dir):
    return linkage.mark_summary(_inferred(spark, sf_dir, _flagged(spark, sf_dir)))


@query(
    "hit_text",
    f"""{INFERRED} select h.read_id, h.pos, mi.kmer||' '||case when h.is_fwd then 'F' else 'R' end||' d '||mi.depth||' C'||(mi.info&3)
||case when in_ref then ' P ' else ' p ' end||coalesce(ref_pos,0) as text from h join mi on h.kmer=mi.kmer""",
)
def hit_text(spark, sf_dir):
    loaded = _flagged(spark, sf_dir)
    return linkage.hit_text(loaded, checkpointed(_inferred(spark, sf_dir, loaded)))


RESET = f"{INFERRED} select kmer, (info&252) | case when coalesce(kind='core',false) {{0}} then 1 else 0 end as info from mi"


@query("reset_bits_1", RESET.format(""))
def reset_bits_1(spark, sf_dir):
    return linkage.reset_core(_inferred(spark, sf_dir, _flagged(spark, sf_dir))).select("kmer", "info")


@query("reset_bits_2", RESET.format("and info&8=0"))
def reset_bits_2(spark, sf_dir):
    return linkage.reset_core(_inferred(spark, sf_dir, _flagged(spark, sf_dir)), skip_repeats=True).select("kmer", "info")


@query("reset_bits_3", RESET.format("and kmer not in (select kmer from h where read_id=0 group by kmer having count(*)>1)"))
def reset_bits_3(spark, sf_dir):
    loaded = _flagged(spark, sf_dir)
    return linkage.reset_core_by_read(_inferred(spark, sf_dir, loaded), loaded, 0).select("kmer", "info")


TESTED = f"""{INFERRED}, hh as materialized (select h.read_id, h.len, h.kmer, h.is_fwd, h.pos, mi.depth, mi.info from h join mi on h.kmer=mi.kmer
 where mi.info&3<>0 and mi.info&32<>0 and mi.info&8=0),
an as materialized (select kmer as anchor, any_value(depth) as anchor_depth, read_id, min(pos) as pos, arg_min(is_fwd,pos) as is_fwd, max(len) as len
 from hh where depth>={LOW} and depth<{HIGH} group by kmer, read_id),
ar as materialized (select *, case when is_fwd then pos else len-pos-{fx.DENSE.w} end as upstream, case when is_fwd then len-pos-{fx.DENSE.w} else pos end as downstream from an),
ap as materialized (select anchor, anchor_depth, hh.kmer as mod, hh.depth as mod_depth, ar.read_id, (hh.pos-ar.pos)*case when ar.is_fwd then 1 else -1 end as dx
 from ar join hh on hh.read_id=ar.read_id and hh.pos<>ar.pos),
gp as (select anchor, any_value(anchor_depth) as anchor_depth, mod, any_value(mod_depth) as mod_depth, count(*) as n, min(dx) as lo, max(dx) as hi from ap group by anchor, mod),
gd as (select *, lo>0 as is_down, lo<=0 and hi>0 as is_split, case when lo>0 then lo when hi>0 then -lo else -hi end as dist from gp),
rs as (select anchor, false as is_down, upstream as dist from ar union all select anchor, true, downstream from ar),
ev as (select anchor, is_down, dist, 1 as reach, null::bigint as mod from rs union all select anchor, is_down, dist, 0, mod from gd),
ec as materialized (select *, sum(reach) over (partition by anchor, is_down order by dist desc range unbounded preceding)::bigint as reaching from ev),
tp as materialized (select gd.anchor, gd.anchor_depth, gd.mod, gd.mod_depth, gd.is_down, gd.is_split, gd.n, gd.dist, ec.reaching,
 gd.n<gd.mod_depth and 2*gd.n<ec.reaching as is_poor, gd.n=gd.mod_depth or gd.n>=0.8::double*ec.reaching as is_good, gd.n=1 and ec.reaching>=10 as is_single
 from gd join ec on ec.reach=0 and ec.anchor=gd.anchor and ec.mod=gd.mod)"""


def _testable(spark, sf_dir, loaded):
    marks = checkpointed(_inferred(spark, sf_dir, loaded))
    return readset.with_info(loaded, marks.where(linkage.eligible(F.col("info"))), sparse=True), marks


def _dealt(spark, sf_dir):
    """The reads for the linkage test, and the marks. The seeds, their hits and all that was shuffled on the way are off the disk."""
    with passing_shuffles(spark):
        loaded = _flagged(spark, sf_dir)
        testable, marks = _testable(spark, sf_dir, loaded)
        dealt = linkage.deal(testable, LOW, HIGH)
        discard(loaded.seeds)
    return dealt, marks


@query(
    "anchor_pairs",
    f"""{TESTED} select anchor, any_value(anchor_depth) as anchor_depth, count(*) as n_pairs, count(distinct mod) as n_mods,
min(dx) as low, max(dx) as high, sum(dx)::bigint as total, {sql.content('mod', 'mod_depth', 'read_id', 'dx')} as content from ap group by anchor""",
)
def anchor_pairs(spark, sf_dir):
    """All pairs (millions of rows), reported per anchor with a hash of all their values."""
    columns = [
        F.max("anchor_depth").alias("anchor_depth"), F.count(F.lit(1)).alias("n_pairs"), F.count_if("is_first").alias("n_mods"),
        F.min("dx").alias("low"), F.max("dx").alias("high"), F.sum("dx").alias("total"), fx.content("mod", "mod_depth", "read_id", "dx").alias("content"),
    ]
    return linkage.by_anchor(_dealt(spark, sf_dir)[0], False, lambda pairs: pairs.groupBy("anchor").agg(*columns))


@query(
    "reach_counts",
    f"""{TESTED}, sd as (select anchor, case when is_down then 'down' else 'up' end as side, dist, count(*) as n from rs group by all)
select anchor, side, dist, sum(n) over (partition by anchor, side order by dist desc)::bigint as n_reads from sd""",
)
def reach_counts(spark, sf_dir):
    return linkage.reach_counts(linkage.anchor_reads(_testable(spark, sf_dir, _flagged(spark, sf_dir))[0], LOW, HIGH))


VERDICTS = ("is_down", "is_split", "is_poor", "is_good", "is_single")


@query(
    "test_pairs",
    f"""{TESTED} select anchor, count(*) as n_mods, sum(n)::bigint as n, sum(dist)::bigint as dist, sum(reaching)::bigint as reaching,
{', '.join(f'count(case when {v} then 1 end) as {v}' for v in VERDICTS)},
{sql.content('mod', 'mod_depth', 'n', 'dist', 'reaching', *VERDICTS)} as content from tp group by anchor""",
)
def test_pairs(spark, sf_dir):
    """All verdicts, reported per anchor with a hash of all their values."""
    columns = [
        F.count(F.lit(1)).alias("n_mods"), *[F.sum(c).alias(c) for c in ("n", "dist", "reaching")],
        *[F.count(F.when(F.col(v), 1)).alias(v) for v in VERDICTS], fx.content("mod", "mod_depth", "n", "dist", "reaching", *VERDICTS).alias("content"),
    ]
    return linkage.by_anchor(_dealt(spark, sf_dir)[0], True, lambda verdicts: verdicts.groupBy("anchor").agg(*columns))


def _counts_sql(run: int) -> str:
    extra = " + case when is_poor then 1 else 0 end" if run > 3 else ""
    return f"""lc as materialized (select kmer, sum(g)::bigint as n_good, sum(p)::bigint as n_poor, sum(s)::bigint as n_split, sum(b)::bigint as n_bad_link, sum(sl)::bigint as n_split_link from (
select anchor as kmer, is_good::int as g, is_poor::int as p, is_split::int as s, (is_down and is_single)::int as b, 0 as sl from tp
union all select mod, 0, 0, 0, (not is_down and is_single and not is_poor)::int{extra}, is_split::int from tp) group by kmer)"""


def _test_sql(run: int, rule: str) -> str:
    return f"""{TESTED}, {_counts_sql(run)} select mi.kmer, case when lc.kmer is not null and ({rule}) then info&252 else info end as info,
n_good, n_poor, n_split, n_bad_link, n_split_link from mi left join lc on mi.kmer=lc.kmer"""


def _test_mods(spark, sf_dir, run):
    dealt, marks = _dealt(spark, sf_dir)
    counts = linkage.counts_of_rounds(dealt, run)
    zeroed = linkage.zero_unlinked(marks.select("kmer", "info"), counts, run)
    return zeroed.join(counts, "kmer", "left")


@query("test_mods", _test_sql(1, "n_good<n_poor or n_split>10"))
def test_mods(spark, sf_dir):
    return _test_mods(spark, sf_dir, 1)


@query("test_mods_run3", _test_sql(3, "n_good<n_poor or n_poor>25 or n_split>0 or n_bad_link>10"))
def test_mods_run3(spark, sf_dir):
    return _test_mods(spark, sf_dir, 3)


@query("test_mods_run4", _test_sql(4, "n_good<n_poor or n_split>0 or n_bad_link>6"))
def test_mods_run4(spark, sf_dir):
    return _test_mods(spark, sf_dir, 4)
