"""Building blocks of the DuckDB statements that queries are checked against."""

from __future__ import annotations

from strandloom.params import SketchParams

_BASES = "upper(regexp_replace({0},'[^ACGTNacgtn]','','g'))"


def bases(column: str) -> str:
    return _BASES.format(column)


def clean(column: str) -> str:
    return f"translate({bases(column)},'N','A')"


DOCUMENTS = f"select doc_id as read_id, {clean('text')} as seq from documents"
CONVERSATIONS = f"select conv_id*1000+turn as read_id, {clean('text')} as seq from conversations"
PAGES = f"select page_id as read_id, {clean('html')} as seq from pages"
BENCHMARK = f"select item_id as read_id, {clean('text')} as seq from benchmark"


def _bits(seq: str, codes: str) -> str:
    out = seq
    for letter, code in zip("ACGT", codes.split()):
        out = f"replace({out},'{letter}','{code}')"
    return out


def hash_of(kmer: str, p: SketchParams) -> str:
    product = f"(({kmer})::hugeint*{p.factor}::hugeint)"
    return f"(({product} % 18446744073709551616::hugeint) // {2**p.shift}::hugeint)::bigint"


def windows(name: str, reads: str, p: SketchParams) -> str:
    """CTEs ending in ``{name}_all``: every window with both codes and hashes."""
    k = p.k
    return f"""
{name}_b as materialized (
  select read_id, length(seq) as len, {_bits('seq', '00 01 10 11')} as fb,
         {_bits('reverse(seq)', '11 10 01 00')} as rb
  from ({reads}) where length(seq) >= {k}),
{name}_p as (select read_id, len, fb, rb, unnest(range(0, len-{k - 1})) as pos from {name}_b),
{name}_c as (
  select read_id, len, pos, substr(fb, 2*pos+1, {2 * k})::bit::bigint as kf,
         substr(rb, 2*(len-{k}-pos)+1, {2 * k})::bit::bigint as kr from {name}_p),
{name}_all as (
  select *, {hash_of('kf', p)} as hf, {hash_of('kr', p)} as hr from {name}_c)"""


def hits(name: str, reads: str, p: SketchParams) -> str:
    """CTEs ending in ``{name}``: read_id, len, ord, kmer, hash, is_fwd, pos of sampled windows."""
    return f"""{windows(name, reads, p)},
{name} as materialized (
  select read_id, len, (row_number() over (partition by read_id order by pos)-1)::integer as ord,
         case when hf<hr then kf else kr end as kmer, least(hf,hr) as hash, hf<hr as is_fwd,
         pos::integer as pos, kf
  from {name}_all where least(hf,hr) % {p.w} = 0)"""


def counts(name: str, source: str) -> str:
    """CTE ``{name}``: kmer, depth (saturating) and idx by first occurrence."""
    return f"""
{name} as materialized (
  select kmer, depth, row_number() over (order by fr, fp) as idx from (
    select kmer, least(count(*), 65535)::integer as depth, min(read_id) as fr,
           arg_min(pos, read_id*1000000000+pos) as fp from {source} group by kmer))"""


def copy_case(depth: str, single: int, double: int, many: int) -> str:
    return f"case when {depth}<{single} then 0 when {depth}<{double} then 1 when {depth}<{many} then 2 else 3 end"


PRIME = 2147483647


def content(*columns: str) -> str:
    """Sum of a hash of the integer columns over rows: equal for equal sets of rows, whatever their order."""
    h = "0"
    for column in columns:
        h = f"(({h}*48271 + ({column})::bigint % {PRIME} + {PRIME}) % {PRIME})"
    return f"sum(({h}*{h}) % {PRIME})::bigint"
