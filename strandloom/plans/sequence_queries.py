"""Alphabets, per-sequence functions and composition statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators import composition, dictionary
from strandloom.plans import fixtures as fx
from strandloom.plans import sql
from strandloom.plans.registry import query

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLDED = f"translate(text,'{LOWER}','{UPPER}')"


def _converted(alphabet: str) -> str:
    table = S.ALPHABETS[alphabet]
    source = "text" if alphabet == "text" else FOLDED
    return f"translate(regexp_replace({source},'[^{table['from']}]','','g'),'{table['from']}','{table['to']}')"


@query(
    "alphabet_convert",
    f"""select doc_id as read_id, {_converted('text')} as text_seq, {_converted('iupac')} as iupac,
{_converted('iupac_to_n')} as iupac_to_n, {_converted('protein')} as protein from documents""",
)
def alphabet_convert(spark, sf_dir):
    text = F.col("seq")
    return fx.documents(spark, sf_dir).select(
        "read_id",
        S.convert_alphabet(text, "text").alias("text_seq"),
        S.convert_alphabet(text, "iupac").alias("iupac"),
        S.convert_alphabet(text, "iupac_to_n").alias("iupac_to_n"),
        S.convert_alphabet(text, "protein").alias("protein"),
    )


CODE_TABLES = {
    "index": S.INDEX,
    "index4": S.INDEX4,
    "mask": S.MASK,
    "iupac_mask": S.IUPAC_MASK,
    "protein_index": S.protein_codes(),
}


def _code_sql(codes: dict[str, int]) -> str:
    lookup = "map {" + ", ".join(f"'{letter}': {code}" for letter, code in codes.items()) + "}"
    letters = "".join(codes)
    kept = f"string_split(regexp_replace({FOLDED},'[^{letters}]','','g'),'')"
    return f"list_transform(list_filter({kept}, lambda c: c<>''), lambda c: ({lookup})[c])"


@query(
    "alphabet_codes",
    "select doc_id as read_id, "
    + ", ".join(f"coalesce(list_sum({_code_sql(c)}),0)::bigint as {n}_sum, len({_code_sql(c)}) as {n}_n, md5(coalesce(array_to_string({_code_sql(c)},','),'')) as {n}_md5" for n, c in CODE_TABLES.items())
    + " from documents",
)
def alphabet_codes(spark, sf_dir):
    arrays = fx.documents(spark, sf_dir).select(
        "read_id", *[S.letter_codes(F.col("seq"), codes).alias(name) for name, codes in CODE_TABLES.items()]
    )
    columns = []
    for name in CODE_TABLES:
        total = F.aggregate(name, F.lit(0).cast("bigint"), lambda a, v: a + v)
        columns += [total.alias(f"{name}_sum"), F.size(name).cast("bigint").alias(f"{name}_n"), F.md5(F.array_join(F.col(name).cast("array<string>"), ",")).alias(f"{name}_md5")]
    return arrays.select("read_id", *columns)


@query(
    "revcomp",
    f"""select read_id, reverse(translate(seq,'ACGT','TGCA')) as revcomp,
reverse(translate(seq,'{S.IUPAC}','{S.IUPAC_COMPLEMENT}')) as iupac_revcomp
from (select doc_id as read_id, {sql.bases('text')} as seq from documents)""",
)
def revcomp(spark, sf_dir):
    reads = fx.documents(spark, sf_dir).withColumn("seq", S.bases(F.col("seq")))
    return reads.select(
        "read_id",
        S.reverse_complement(F.col("seq")).alias("revcomp"),
        F.reverse(S.complement_iupac(F.col("seq"))).alias("iupac_revcomp"),
    )


@query(
    "homopolymer_compress",
    """with s as (select doc_id as read_id, regexp_replace(text,'[^ACGTNacgtn]','','g') as seq from documents),
c as (select read_id, unnest(string_split(seq,'')) as c, generate_subscripts(string_split(seq,''),1) as i from s where seq<>''),
m as (select *, lag(c) over (partition by read_id order by i) as p from c)
select s.read_id, coalesce(k.seq,'') as seq from s left join (
  select read_id, string_agg(c,'' order by i) as seq from m where p is null or upper(p)<>upper(c) group by read_id) k
on s.read_id=k.read_id""",
)
def homopolymer_compress(spark, sf_dir):
    seq = S.convert_alphabet(F.col("seq"), "text")
    return fx.documents(spark, sf_dir).select("read_id", S.compress_homopolymers(seq).alias("seq"))


QUALITIES = """list_transform(range(0,length(seq)), lambda i: ((ascii(substr(seq,i+1,1))+i) % 41)::integer)"""


@query(
    "qual_threshold",
    f"""select read_id, list_transform({QUALITIES}, lambda q: q>=20) as bits,
len(list_filter({QUALITIES}, lambda q: q>=20)) as n_high from ({sql.CONVERSATIONS})""",
)
def qual_threshold(spark, sf_dir):
    reads = fx.with_quality(fx.clean(fx.conversations(spark, sf_dir)))
    bits = reads.select("read_id", S.quality_bits(F.col("qual"), 20).alias("bits"))
    return bits.select("read_id", "bits", F.size(F.filter("bits", lambda b: b)).cast("bigint").alias("n_high"))


@query(
    "quality_text",
    f"""select read_id, array_to_string(list_transform({QUALITIES}, lambda q: chr(q+33)),'') as quality,
coalesce(list_sum({QUALITIES}),0)::bigint as total from ({sql.CONVERSATIONS})""",
)
def quality_text(spark, sf_dir):
    """Integers to text and back."""
    reads = fx.with_quality(fx.clean(fx.conversations(spark, sf_dir)))
    text = reads.select("read_id", S.quality_text(F.col("qual"), F.col("len")).alias("quality"))
    values = S.quality_values(F.col("quality"))
    return text.select("read_id", "quality", F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


SCALED = "list_transform(embedding, lambda x: floor(x::double*1000)::bigint)"


@query(
    "int_list_delta",
    f"""select vec_id, v as restored, list_transform(range(1,len(v)+1), lambda i:
case when i=1 then v[1] else v[i]-v[i-1] end) as deltas from (select vec_id, {SCALED} as v from embeddings)""",
)
def int_list_delta(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("bigint"))
    coded = vectors.select("vec_id", S.deltas(scaled).alias("deltas"))
    return coded.select("vec_id", "deltas", S.running_totals(F.col("deltas")).alias("restored"))


@query(
    "dict_encode",
    """select event_type, row_number() over (order by min(event_id))-1 as id, min(event_id) as first_seen
from events group by event_type""",
)
def dict_encode(spark, sf_dir):
    return dictionary.encode_first_seen(fx.table(spark, sf_dir, "events"), "event_type", "event_id")


@query(
    "dict_encode_words",
    """with w as (select doc_id, unnest(string_split_regex(text,'[ \\n]+')) as word,
generate_subscripts(string_split_regex(text,'[ \\n]+'),1) as i from documents),
f as (select word, min(doc_id*1000000+i) as seen from w where word<>'' group by word)
select word, row_number() over (order by seen)-1 as id from f""",
)
def dict_encode_words(spark, sf_dir):
    """Words of all documents numbered by first appearance."""
    words = fx.documents(spark, sf_dir).select("read_id", F.posexplode(F.split("seq", "[ \n]+")).alias("i", "word"))
    placed = words.where("word <> ''").select("word", F.struct("read_id", "i").alias("seen"))
    return dictionary.encode_first_seen(placed, "word", "seen").select("word", "id")


@query(
    "dedup_consecutive",
    """select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as p
from events) where p is distinct from event_type""",
)
def dedup_consecutive(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return dictionary.drop_consecutive(rows, ["user_id", "event_id"], ["user_id", "event_type"])


@query("every_kth", f"select read_id, length(seq) as len from ({sql.DOCUMENTS}) where read_id % 10 = 0")
def every_kth(spark, sf_dir):
    """The reference behaviour of reporting every k-th read is the feature here."""
    return fx.clean(fx.documents(spark, sf_dir)).where("read_id % 10 = 0").select("read_id", F.col("len").cast("bigint").alias("len"))


@query(
    "base_composition",
    """with b as (select unnest(string_split(regexp_replace(text,'[^ACGTNacgtn]','','g'),'')) as base from documents)
select base, count(*) as n, count(*)*100.0::double/sum(count(*)) over () as pct from b where base<>'' group by base""",
)
def base_composition(spark, sf_dir):
    return composition.base_composition(fx.documents(spark, sf_dir))


@query(
    "byte_histogram",
    """with t as (select hex(encode(html)) as h from pages union all select hex(encode(text)) from documents),
c as (select unnest(list_transform(range(0,length(h)//2), lambda i: substr(h, 2*i+1, 2))) as b from t)
select ((position(b[1] in '0123456789ABCDEF')-1)*16+position(b[2] in '0123456789ABCDEF')-1)::integer as byte, count(*) as n
from c group by 1""",
)
def byte_histogram(spark, sf_dir):
    """All bytes of the pages and the documents."""
    return composition.byte_histogram(fx.pages(spark, sf_dir).unionByName(fx.documents(spark, sf_dir)))


@query(
    "quality_histogram",
    f"""with q as (select unnest({QUALITIES}) as qual from ({sql.DOCUMENTS})),
g as (select qual, count(*) as n from q group by qual)
select qual, n, n*100.0::double/sum(n) over () as pct, sum(n) over (order by qual)*100.0::double/sum(n) over () as cum_pct from g""",
)
def quality_histogram(spark, sf_dir):
    return composition.quality_histogram(fx.with_quality(fx.clean(fx.documents(spark, sf_dir))))


LENGTHS = f"with l as (select length(seq) as len from ({sql.DOCUMENTS}))"


@query(
    "length_summary",
    f"""{LENGTHS} select count(*) as n_seq, sum(len)::bigint as total, sum(len)::double/count(*) as mean,
min(case when len>0 then len end) as min_len, max(len) as max_len from l""",
)
def length_summary(spark, sf_dir):
    return composition.length_summary(fx.clean(fx.documents(spark, sf_dir)))


@query(
    "length_n50",
    f"""{LENGTHS}, b as (select floor(10*sqrt(len))::bigint as bin, sum(len) as bases from l group by 1),
c as (select bin, sum(bases) over (order by bin) as cum, sum(bases) over () as tot from b)
select ((min(bin)+1)*(min(bin)+2)//100)::bigint as n50 from c where 2*cum>=tot""",
)
def length_n50(spark, sf_dir):
    return composition.length_n50(fx.clean(fx.documents(spark, sf_dir)))


@query(
    "length_bins",
    f"""{LENGTHS}, b as (select floor(10*sqrt(len))::bigint as bin, count(*) as n from l group by 1),
t as (select *, max(bin) over () as top, greatest(1,(max(bin) over ()+1)//20) as d from b)
select (e*e//100)::bigint as length_from, sum(n)::bigint as n
from (select n, top-((top-bin)//d)*d as e from t) group by e""",
)
def length_bins(spark, sf_dir):
    return composition.length_distribution(fx.clean(fx.documents(spark, sf_dir)))
