"""Sampling, k-mer integers and k-mer count tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import kmers as K
from strandloom.functions.sequences import reverse_complement
from strandloom.operators import kmerset, sketch
from strandloom.plans import fixtures as fx
from strandloom.plans import sql
from strandloom.plans.registry import query

HITS = f"with {sql.hits('h', sql.DOCUMENTS, fx.DEFAULT)}"
COUNTS = f"{HITS}, {sql.counts('t', 'h')}"


def _documents_table(spark, sf_dir, params=fx.DEFAULT):
    return kmerset.count_kmers(fx.documents(spark, sf_dir), params)


@query("sampled_kmers", f"{HITS} select read_id, ord, kmer, is_fwd, pos from h")
def sampled_kmers(spark, sf_dir):
    return sketch.sampled_kmers(fx.documents(spark, sf_dir), fx.DEFAULT)


@query(
    "sampled_kmers_long",
    f"with {sql.hits('h', sql.DOCUMENTS, fx.LONG)} select read_id, ord, kmer, is_fwd, pos from h",
)
def sampled_kmers_long(spark, sf_dir):
    """62-bit k-mers."""
    return sketch.sampled_kmers(fx.documents(spark, sf_dir), fx.LONG)


@query(
    "jumping_minimizers",
    f"""with recursive {sql.windows('h', sql.DOCUMENTS, fx.DEFAULT)},
keyed as materialized (
  select read_id, pos, least(hf,hr) as hash, hf<hr as is_fwd,
         least(hf,hr)::hugeint*{fx.DEFAULT.w} + pos % {fx.DEFAULT.w} as key, len-{fx.DEFAULT.k - 1} as n from h_all),
best as materialized (
  select read_id, pos, n, min(key) over (partition by read_id order by pos
         rows between current row and {fx.DEFAULT.w - 1} following) as low from keyed),
reads as materialized (
  select read_id, n, list(low // {fx.DEFAULT.w} order by pos) as hs,
         list((pos + (low % {fx.DEFAULT.w} - pos % {fx.DEFAULT.w} + {fx.DEFAULT.w}) % {fx.DEFAULT.w})::integer order by pos) as nxt
  from best group by read_id, n),
hops as (
  select read_id, 0 as ord, nxt[1] as pos, hs[1] as hash from reads
  union all
  select o.read_id, o.ord+1, r.nxt[o.pos+2], r.hs[o.pos+2] from hops o join reads r using (read_id)
  where o.pos+1 < r.n and (o.pos+{fx.DEFAULT.w} < r.n or r.hs[o.pos+2] < o.hash))
select o.read_id, o.ord::integer as ord, o.hash::bigint as hash, k.is_fwd, o.pos::integer as pos
from hops o join keyed k on o.read_id=k.read_id and o.pos=k.pos""",
)
def jumping_minimizers(spark, sf_dir):
    return sketch.jumping_minimizers(fx.documents(spark, sf_dir), fx.DEFAULT)


def _hit_texts(spark, sf_dir):
    """The text under every sampled position, spelled from the canonical k-mer."""
    hits = sketch.sampled_kmers(fx.documents(spark, sf_dir), fx.DEFAULT, emit=("kmer", "is_fwd", "pos"))
    spelled = K.decode(F.col("kmer"), fx.DEFAULT.k)
    return hits.select(
        "read_id", "pos", F.when(F.col("is_fwd"), spelled).otherwise(reverse_complement(spelled)).alias("text")
    )


@query("kmer_encode", f"{HITS} select read_id, pos, kf as code from h")
def kmer_encode(spark, sf_dir):
    return _hit_texts(spark, sf_dir).select("read_id", "pos", K.encode(F.col("text")).alias("code"))


@query(
    "kmer_decode",
    f"""{HITS}, d as (select distinct kmer from h),
b as (select kmer, kmer::bit::varchar as bits from d),
c as (select kmer, list_transform(range(0,{fx.DEFAULT.k}), lambda i:
      substr('acgt', 1 + substr(bits, 64-{2 * fx.DEFAULT.k}+2*i+1, 1)::integer*2
                       + substr(bits, 64-{2 * fx.DEFAULT.k}+2*i+2, 1)::integer, 1)) as letters from b)
select kmer, array_to_string(letters,'') as text from c""",
)
def kmer_decode(spark, sf_dir):
    return _documents_table(spark, sf_dir).select("kmer", K.decode(F.col("kmer"), fx.DEFAULT.k).alias("text"))


@query(
    "kmer_hash",
    f"{HITS} select distinct kmer, {sql.hash_of('kmer', fx.DEFAULT)} as hash from h",
)
def kmer_hash(spark, sf_dir):
    return _documents_table(spark, sf_dir).select("kmer", K.hash_code(F.col("kmer"), fx.DEFAULT).alias("hash"))


@query("canonical_kmer", f"{HITS} select read_id, pos, kmer, hash, is_fwd from h")
def canonical_kmer(spark, sf_dir):
    """Expression form of the canonical strand, without the Arrow kernel's integers."""
    parts = K.canonical_parts(F.col("text"), fx.DEFAULT)
    texts = _hit_texts(spark, sf_dir).select("read_id", "pos", *[c.alias(n) for n, c in parts.items()])
    wins = F.col("hash_f") < F.col("hash_r")
    return texts.select(
        "read_id",
        "pos",
        F.when(wins, F.col("kmer_f")).otherwise(F.col("kmer_r")).alias("kmer"),
        F.least("hash_f", "hash_r").alias("hash"),
        wins.alias("is_fwd"),
    )


@query("kmer_count", f"{COUNTS} select kmer, depth from t")
def kmer_count(spark, sf_dir):
    return _documents_table(spark, sf_dir).select("kmer", "depth")


LINKED = f"""select read_id, case when n%2=1 then substr(seq,24) else seq end as seq
from (select *, row_number() over (order by read_id) as n from ({sql.DOCUMENTS}))"""


@query(
    "kmer_count_10x",
    f"with {sql.hits('h', LINKED, fx.DEFAULT)} select kmer, least(count(*),65535)::integer as depth from h group by kmer",
)
def kmer_count_10x(spark, sf_dir):
    linked = kmerset.linked_reads(fx.documents(spark, sf_dir))
    return kmerset.count_kmers(linked, fx.DEFAULT).select("kmer", "depth")


@query(
    "add_summary",
    f"""{COUNTS} select (select count(*) from documents) as n_seq,
(select sum(length({sql.bases('text')})) from documents)::bigint as tot_len,
(select count(*) from h) as tot_hash, (select count(*) from t) as n_kmers""",
)
def add_summary(spark, sf_dir):
    reads = fx.documents(spark, sf_dir)
    return kmerset.add_summary(reads, kmerset.count_kmers(reads, fx.DEFAULT), fx.DEFAULT)


@query("depth_histogram", f"{COUNTS} select depth, count(*) as n_kmers from t group by depth")
def depth_histogram(spark, sf_dir):
    return kmerset.depth_histogram(_documents_table(spark, sf_dir))


COPY = "2,5,20"
CLASSED = f"{COUNTS}, s as materialized (select *, {sql.copy_case('depth', 2, 5, 20)} as info from t)"


def _classed(spark, sf_dir):
    return kmerset.set_copy(_documents_table(spark, sf_dir), 2, 5, 20)


@query(
    "kmerset_summary",
    f"""{CLASSED}, g as (select depth, count(*) as n from s group by depth),
c as (select depth, n, sum(depth*n) over (order by depth) as cum, sum(depth*n) over () as tot from g)
select (select count(*) from s) as n_kmers, (select sum(depth) from s)::bigint as total_count,
(select sum(depth)::double/count(*) from s) as mean_depth,
(select min(depth) from c where cum > tot//2) as n50_depth,
(select count(*) from s where info=0) as copy0, (select count(*) from s where info=1) as copy1,
(select count(*) from s where info=2) as copy2, (select count(*) from s where info=3) as copy3""",
)
def kmerset_summary(spark, sf_dir):
    return kmerset.summarize(_classed(spark, sf_dir))


@query("set_copy", f"{CLASSED} select kmer, depth, info from s")
def set_copy(spark, sf_dir):
    return _classed(spark, sf_dir)


@query(
    "set_copy_m",
    f"{CLASSED} select kmer, depth, case when depth>=10 then 3 else info end as info from s",
)
def set_copy_m(spark, sf_dir):
    return kmerset.set_copy_many(_classed(spark, sf_dir), 10)


@query(
    "kmer_prune",
    f"""{COUNTS} select row_number() over (order by idx) as idx, kmer, depth, 0 as info
from t where depth>=2 and depth<100""",
)
def kmer_prune(spark, sf_dir):
    table = kmerset.count_kmers_in_order(fx.documents(spark, sf_dir), fx.DEFAULT)
    return kmerset.reindex(kmerset.prune(table, 2, 100)).select("idx", "kmer", "depth", "info")


MERGE_SQL = f"""with {sql.hits('a', sql.DOCUMENTS, fx.DEFAULT)}, {sql.hits('b', sql.CONVERSATIONS, fx.DEFAULT)},
x as (select kmer, least(count(*),65535)::integer as depth from a group by kmer),
y as (select kmer, least(count(*),65535)::integer as depth from b group by kmer),
xi as (select *, {sql.copy_case('depth', 2, 5, 20)} | case when depth>=5 then 8 else 0 end as info from x),
yi as (select *, {sql.copy_case('depth', 1, 3, 9)} as info from y)"""


@query(
    "kmer_merge",
    f"""{MERGE_SQL} select coalesce(xi.kmer,yi.kmer) as kmer,
least(coalesce(xi.depth,0)+coalesce(yi.depth,0),65535)::integer as depth,
case when yi.kmer is null then xi.info
     else (coalesce(xi.info,0)&3) | least((coalesce(xi.info,0)&3)+(yi.info&3),3) end as info
from xi full outer join yi on xi.kmer=yi.kmer""",
)
def kmer_merge(spark, sf_dir):
    left = _classed(spark, sf_dir)
    left = left.withColumn("info", K.with_flag(F.col("info"), K.REPEAT, F.col("depth") >= 5))
    right = kmerset.set_copy(kmerset.count_kmers(fx.conversations(spark, sf_dir), fx.DEFAULT), 1, 3, 9)
    return kmerset.merge(left, right, fx.DEFAULT, fx.DEFAULT)


@query(
    "info_bits",
    f"""{MERGE_SQL} select kmer, info, (info&3) as copy, (info&8)<>0 as is_repeat, (info&4)<>0 as is_minor,
(info&252)|2 as as_double from xi""",
)
def info_bits(spark, sf_dir):
    table = _classed(spark, sf_dir)
    info = K.with_flag(F.col("info"), K.REPEAT, F.col("depth") >= 5)
    table = table.withColumn("info", info)
    return table.select(
        "kmer",
        "info",
        K.copy_class(F.col("info")).alias("copy"),
        K.has_flag(F.col("info"), K.REPEAT).alias("is_repeat"),
        K.has_flag(F.col("info"), K.MINOR).alias("is_minor"),
        K.with_copy(F.col("info"), 2).alias("as_double"),
    )


@query(
    "depth_compare",
    f"""with {sql.hits('a', sql.DOCUMENTS, fx.DEFAULT)}, {sql.hits('b', sql.CONVERSATIONS, fx.DEFAULT)},
{sql.hits('c', sql.PAGES, fx.DEFAULT)},
x as (select kmer, least(count(*),65535)::integer as depth from a group by kmer),
y as (select kmer, least(count(*),65535)::integer as depth from b group by kmer),
z as (select kmer, least(count(*),65535)::integer as depth from c group by kmer)
select x.kmer, {sql.copy_case('x.depth', 2, 5, 20)} as copy, x.depth,
coalesce(y.depth,0) as conversations, coalesce(z.depth,0) as pages
from x left join y on x.kmer=y.kmer left join z on x.kmer=z.kmer""",
)
def depth_compare(spark, sf_dir):
    others = {
        "conversations": kmerset.count_kmers(fx.conversations(spark, sf_dir), fx.DEFAULT),
        "pages": kmerset.count_kmers(fx.pages(spark, sf_dir), fx.DEFAULT),
    }
    return kmerset.compare_depths(_classed(spark, sf_dir), others)
