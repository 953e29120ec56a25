"""Sequence files, k-mer table text, typed record files, site and sample files.

Each scan query first writes the shared table in the format with Spark, then
reads the files back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.sequences import (
    bases,
    compress_homopolymers,
    convert_alphabet,
    quality_text,
    reverse_complement,
    unknown_as_a,
)
from strandloom.operators import kmerset
from strandloom.plans import fixtures as fx
from strandloom.plans import sql
from strandloom.plans.kmer_queries import COUNTS
from strandloom.plans.registry import query
from strandloom.plans.sequence_queries import QUALITIES
from strandloom.session import spread
from strandloom.sources import kmer_tables, records, sequence_files, variants
from strandloom.sources.lines import scratch_path, write_lines


def _named_documents(spark, sf_dir):
    docs = spread(fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("read_id"),
        F.concat(F.lit("d"), F.col("doc_id")).alias("name"),
        F.col("lang").alias("desc"),
        convert_alphabet(F.col("text"), "text").alias("seq"),
    )


NAMED = """select doc_id, 'd'||doc_id as name, lang as "desc", regexp_replace(text,'[^ACGTNacgtn]','','g') as seq from documents"""
CLEAN_NAMED = f"""select doc_id, 'd'||doc_id as name, lang as "desc", {sql.clean('text')} as seq from documents"""


@query("fasta_format", f"""select doc_id as read_id, '>'||name||' '||"desc"||chr(10)||seq as value from ({NAMED})""")
def fasta_format(spark, sf_dir):
    return sequence_files.fasta_text(_named_documents(spark, sf_dir))


@query(
    "fasta_scan",
    f"""select row_number() over (order by doc_id) as read_id, name, "desc", seq from ({NAMED})""",
)
def fasta_scan(spark, sf_dir):
    path = scratch_path(spark, "fasta")
    # Sequences broken into 60-letter lines with junk, as files in the wild have.
    wrapped = F.regexp_replace("seq", "(.{60})", "$1 \n")
    sequence_files.write_sequences(_named_documents(spark, sf_dir).withColumn("seq", wrapped), path, "fasta")
    return sequence_files.read_fasta(spark, path)


def _quality_documents(spark, sf_dir):
    reads = fx.clean(_named_documents(spark, sf_dir))
    return fx.with_quality(reads).drop("len")


QUALITY_STRING = f"array_to_string(list_transform({QUALITIES}, lambda q: chr(q+33)),'')"


@query(
    "fastq_format",
    f"""select doc_id as read_id, '@'||name||' '||"desc"||chr(10)||seq||chr(10)||'+'||chr(10)||{QUALITY_STRING} as value
from ({CLEAN_NAMED})""",
)
def fastq_format(spark, sf_dir):
    return sequence_files.fastq_text(_quality_documents(spark, sf_dir))


@query(
    "fastq_scan",
    f"""select row_number() over (order by doc_id) as read_id, name, "desc", seq, {QUALITIES} as qual from ({CLEAN_NAMED})""",
)
def fastq_scan(spark, sf_dir):
    path = scratch_path(spark, "fastq")
    sequence_files.write_sequences(_quality_documents(spark, sf_dir), path, "fastq")
    return sequence_files.read_fastq(spark, path)


@query(
    "fastq_gzip_scan",
    f"""select row_number() over (order by doc_id) as read_id, name, "desc", length(seq) as len, seq, list_transform(range(length(seq)), lambda i: 0::integer) as qual
from ({CLEAN_NAMED})""",
)
def fastq_gzip_scan(spark, sf_dir):
    path = scratch_path(spark, "reads") + ".fq.gz"
    sequence_files.write_sequences(_quality_documents(spark, sf_dir).drop("qual"), path)
    return sequence_files.read_sequences(spark, path).select("read_id", "name", "desc", F.length("seq").cast("bigint").alias("len"), "seq", "qual")


@query(
    "sam_scan",
    f"""select row_number() over (order by doc_id) as read_id, name, '' as "desc", seq, {QUALITIES} as qual from ({CLEAN_NAMED})""",
)
def sam_scan(spark, sf_dir):
    """Every second record is stored on the reverse strand."""
    reads = _quality_documents(spark, sf_dir)
    is_reverse = F.col("read_id") % 2 == 1
    stored = F.when(is_reverse, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    qual = quality_text(F.when(is_reverse, F.reverse("qual")).otherwise(F.col("qual")), F.length("seq"))
    flag = F.when(is_reverse, "16").otherwise("0")
    line = F.concat_ws("\t", "name", flag, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), stored, qual)
    header = spark.range(1).select(F.lit(-1).cast("bigint").alias("read_id"), F.lit("@HD\tVN:1.6").alias("value"))
    path = scratch_path(spark, "sam")
    write_lines(header.unionByName(reads.select("read_id", line.alias("value"))), ["read_id"], path)
    return sequence_files.read_sequences(spark, path)


@query(
    "seq_record_scan",
    f"""select row_number() over (order by doc_id) as read_id, name, '' as "desc", seq, {QUALITIES} as qual from ({CLEAN_NAMED})""",
)
def seq_record_scan(spark, sf_dir):
    path = scratch_path(spark, "seq") + ".rec"
    sequence_files.write_sequences(_quality_documents(spark, sf_dir), path)
    return sequence_files.read_sequences(spark, path)


@query(
    "convert_formats",
    f"""select row_number() over (order by doc_id) as read_id, name, length(seq) as len, md5(seq) as seq_md5 from ({CLEAN_NAMED})""",
)
def convert_formats(spark, sf_dir):
    """FASTQ to records to FASTA to Parquet."""
    root = scratch_path(spark, "convert")
    sequence_files.write_sequences(_quality_documents(spark, sf_dir), f"{root}/a.fq")
    sequence_files.convert(spark, f"{root}/a.fq", f"{root}/b.rec")
    sequence_files.convert(spark, f"{root}/b.rec", f"{root}/c.fa.gz")
    sequence_files.convert(spark, f"{root}/c.fa.gz", f"{root}/d.parquet")
    reads = sequence_files.read_sequences(spark, f"{root}/d.parquet")
    return reads.select("read_id", "name", F.length("seq").cast("bigint").alias("len"), F.md5("seq").alias("seq_md5"))


@query(
    "homopolymer_fasta",
    """with s as (select doc_id, regexp_replace(text,'[^ACGTNacgtn]','','g') as seq from documents),
c as (select doc_id, unnest(string_split(seq,'')) as c, generate_subscripts(string_split(seq,''),1) as i from s where seq<>''),
m as (select *, lag(c) over (partition by doc_id order by i) as p from c),
k as (select doc_id, count(*) as n, string_agg(c, '' order by i) as kept from m where p is null or upper(p)<>upper(c) group by doc_id)
select row_number() over (order by s.doc_id) as read_id, 'd'||s.doc_id as name, coalesce(n,0) as len, coalesce(kept,'') as seq from s left join k on s.doc_id=k.doc_id""",
)
def homopolymer_fasta(spark, sf_dir):
    """Scan, compress, write gzip FASTA, scan."""
    root = scratch_path(spark, "hoco")
    sequence_files.write_sequences(_named_documents(spark, sf_dir), f"{root}/in.fa")
    reads = sequence_files.read_sequences(spark, f"{root}/in.fa")
    compressed = reads.withColumn("seq", compress_homopolymers(F.col("seq"))).withColumn("desc", F.lit(""))
    sequence_files.write_sequences(compressed, f"{root}/out.fa.gz")
    out = sequence_files.read_sequences(spark, f"{root}/out.fa.gz")
    return out.select("read_id", "name", F.length("seq").cast("bigint").alias("len"), "seq")


KMER_TEXT = """list_transform(range(0,19), lambda i: substr('acgt',1+((kmer>>(2*(18-i)))&3),1))"""


@query(
    "kmer_text_dump",
    f"""{COUNTS} select idx, idx||chr(9)||array_to_string({KMER_TEXT},'')||chr(9)||depth||chr(9)||0 as value from t""",
)
def kmer_text_dump(spark, sf_dir):
    table = kmerset.count_kmers_in_order(fx.documents(spark, sf_dir), fx.DEFAULT)
    return kmer_tables.text_rows(table, fx.DEFAULT)


@query("kmer_text_roundtrip", f"{COUNTS} select idx, kmer, depth, 0 as info from t")
def kmer_text_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "kmers")
    table = kmerset.count_kmers_in_order(fx.documents(spark, sf_dir), fx.DEFAULT)
    kmer_tables.write_text(table, fx.DEFAULT, path)
    return kmer_tables.read_text(spark, path)[0]


@query("kmer_table_roundtrip", f"{COUNTS} select kmer, depth, 0 as info from t")
def kmer_table_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "kmer-table")
    kmer_tables.write_table(kmerset.count_kmers(fx.documents(spark, sf_dir), fx.DEFAULT), fx.DEFAULT, path)
    return kmer_tables.read_table(spark, path)[0]


def _conversation_lines(spark, sf_dir):
    seq = unknown_as_a(bases(F.col("text")))
    schema = records.SEQUENCE_SCHEMA
    turns = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", seq.alias("seq"))
    groups = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    name = F.concat(F.lit("conv "), F.col("conv_id"))
    group_lines = groups.select(
        "conv_id",
        F.lit(-1).cast("bigint").alias("turn"),
        F.lit(0).alias("part"),
        records.format_line("g", schema.lines["g"].fields, [F.col("n"), name]).alias("value"),
    )
    pair = F.array(
        F.struct(F.lit(1).alias("part"), records.format_line("S", ("DNA",), [F.col("seq")]).alias("value")),
        F.struct(F.lit(2).alias("part"), records.format_line("I", ("STRING",), [F.col("role")]).alias("value")),
    )
    return group_lines.unionByName(turns.select("conv_id", "turn", F.inline(pair)))


TURNS = f"""with c as (select conv_id, turn, role, {sql.clean('text')} as seq from conversations),
l as (select conv_id, -1 as turn, 0 as part, 'g '||count(*)||' '||length('conv '||conv_id)||' conv '||conv_id as value from c group by conv_id
union all select conv_id, turn, 1, 'S '||length(seq)||' '||seq from c
union all select conv_id, turn, 2, 'I '||length(role)||' '||role from c)"""


@query("record_format", f"{TURNS} select conv_id, turn, part, value from l")
def record_format(spark, sf_dir):
    return _conversation_lines(spark, sf_dir)


def _conversation_file(spark, sf_dir, lines_per_file=None):
    path = scratch_path(spark, "turns")
    lines = _conversation_lines(spark, sf_dir).withColumn("group_id", F.col("conv_id") + 1)
    provenance = records.Header(provenance=(("strandloom", "1", "conversations", "2024-01-01_00:00:00"),))
    records.write_records(lines, ["conv_id", "turn", "part"], records.SEQUENCE_SCHEMA, path, provenance, lines_per_file=lines_per_file)
    return path, records.embedded_schema(spark, path)


def _conversation_records(spark, sf_dir):
    path, schema = _conversation_file(spark, sf_dir)
    return records.read_records(spark, path, schema), schema


def _indexed_conversations(spark, sf_dir):
    path, schema = _conversation_file(spark, sf_dir, 50_000)
    records.write_index(spark, path, schema)
    return path


NUMBERED = """numbered as (select *, row_number() over (order by conv_id, turn, part) as line_no,
sum(case when part=1 then 1 else 0 end) over (order by conv_id, turn, part rows unbounded preceding)::bigint as object_id,
sum(case when part=0 then 1 else 0 end) over (order by conv_id, turn, part rows unbounded preceding)::bigint as group_id from l)"""


@query(
    "record_parse",
    f"""{TURNS}, {NUMBERED} select s.object_id, s.group_id, s.line_no, substr(s.value, 3+position(' ' in substr(s.value,3))) as seq,
i.role, 'conv '||s.conv_id as group_name, g.n as group_n
from numbered s join c i on i.conv_id=s.conv_id and i.turn=s.turn
join (select conv_id, count(*) as n from c group by conv_id) g on g.conv_id=s.conv_id where s.part=1""",
)
def record_parse(spark, sf_dir):
    path, schema = _conversation_file(spark, sf_dir)
    turns = records.objects(records.read_records(spark, path, schema, group_line=True), schema, seq="S", role="I", of="g")
    group = [F.col("of.f1").alias("group_name"), F.col("of.f0").alias("group_n")]
    return turns.select("object_id", "group_id", "line_no", F.col("seq.f0").alias("seq"), F.col("role.f0").alias("role"), *group)


@query(
    "record_counts",
    f"""{TURNS}, {NUMBERED}, z as (select substr(value,1,1) as line_type, group_id,
case part when 0 then length('conv '||conv_id) else split_part(value,' ',2)::bigint end as size from numbered),
p as (select line_type, group_id, count(*) as n, sum(size) as total, max(size) as longest from z group by all)
select line_type, sum(n)::bigint as n, max(longest) as longest, sum(total)::bigint as total,
case when line_type='g' then 0 else max(n) end as group_n, (case when line_type='g' then 0 else max(total) end)::bigint as group_total
from p group by line_type""",
)
def record_counts(spark, sf_dir):
    lines, schema = _conversation_records(spark, sf_dir)
    return records.line_counts(lines, schema)


@query("record_goto_group", f"{TURNS}, {NUMBERED} select line_no, object_id, value from numbered where group_id=7")
def record_goto_group(spark, sf_dir):
    return records.read_indexed(spark, _indexed_conversations(spark, sf_dir), group_id=7).select("line_no", "object_id", "value")


@query("record_goto_object", f"{TURNS}, {NUMBERED} select line_no, group_id, value from numbered where object_id=11")
def record_goto_object(spark, sf_dir):
    return records.read_indexed(spark, _indexed_conversations(spark, sf_dir), object_id=11).select("line_no", "group_id", "value")


@query(
    "record_typed_lists",
    """select vec_id, list_transform(embedding, lambda x: floor(x::double*100)::bigint) as ints,
list_transform(embedding, lambda x: floor(x::double*64)/8) as reals,
['v '||vec_id, '', 'label '||label] as words from embeddings""",
)
def record_typed_lists(spark, sf_dir):
    """Integer, real and string lists written and parsed back."""
    schema = records.parse_schema("P 3 vec\nO V 2 3 INT 8 INT_LIST\nD R 1 9 REAL_LIST\nD W 1 11 STRING_LIST\n")["vec"]
    vectors = fx.table(spark, sf_dir, "embeddings")
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("bigint"))
    reals = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64) / F.lit(8.0))
    words = F.array(F.concat(F.lit("v "), F.col("vec_id")), F.lit(""), F.concat(F.lit("label "), F.col("label")))
    made = vectors.select("vec_id", ints.alias("ints"), reals.alias("reals"), words.alias("words"))
    parts = F.array(
        F.struct(F.lit(0).alias("part"), records.format_line("V", schema.lines["V"].fields, [F.col("vec_id"), F.col("ints")]).alias("value")),
        F.struct(F.lit(1).alias("part"), records.format_line("R", schema.lines["R"].fields, [F.col("reals")]).alias("value")),
        F.struct(F.lit(2).alias("part"), records.format_line("W", schema.lines["W"].fields, [F.col("words")]).alias("value")),
    )
    lines = made.select("vec_id", F.inline(parts)).withColumn("group_id", F.lit(0))
    path = scratch_path(spark, "vectors")
    records.write_records(lines, ["vec_id", "part"], schema, path)
    found = records.objects(records.read_records(spark, path), schema, v="V", r="R", w="W")
    names = {"v.f0": "vec_id", "v.f1": "ints", "r.f0": "reals", "w.f0": "words"}
    return found.select(*[F.col(field).alias(name) for field, name in names.items()])


OTHER_SCHEMA = "P 3 alt\nG g 2 3 INT 6 STRING\nO S 1 6 STRING\n"


@query(
    "schema_check",
    f"""{TURNS} select substr(value,1,1) as line_type, count(*) as n_lines, substr(value,1,1) in ('S','I','g') as as_declared,
substr(value,1,1)='g' as as_in_other from l group by all""",
)
def schema_check(spark, sf_dir):
    """Lines of each type found in the file, and whether two schemas give that type the fields the file declares."""
    lines, schema = _conversation_records(spark, sf_dir)
    found = F.col("line_type")

    def agrees(other: records.RecordSchema):
        same = [k for k, line in schema.lines.items() if k in other.lines and other.lines[k].fields == line.fields]
        return found.isin(same)

    other = records.parse_schema(OTHER_SCHEMA)["alt"]
    counts = lines.groupBy("line_type").agg(F.count(F.lit(1)).alias("n_lines"))
    return counts.select("line_type", "n_lines", agrees(records.SEQUENCE_SCHEMA).alias("as_declared"), agrees(other).alias("as_in_other"))


SITES = f"""with s as (select item_id, length({sql.clean('text')}) as len from benchmark)"""


@query(
    "sites_validated",
    f"""{SITES}, a as (select item_id, 1 as part, 0 as l, len//2 as r from s union all select item_id, 2, len, len//3 from s
union all select item_id, 3, 1, len+1 from s union all select item_id, 4, -1, 2 from s)
select row_number() over (order by item_id, part) as object_id, 'b'||item_id as chrom, l as left_pos, r as right_pos,
case when l>=r then 'positions out of order' when l<0 then 'left position below 0'
when r>(select len from s where s.item_id=a.item_id) then 'right position past the end' else 'ok' end as status from a""",
)
def sites_validated(spark, sf_dir):
    reads = fx.clean(fx.benchmark(spark, sf_dir))
    name = F.concat(F.lit("b"), F.col("read_id"))
    contigs = variants.check_unique_names(reads.select(name.alias("name"), "len"))
    zero, one = F.lit(0), F.lit(1)
    half, third = F.floor(F.col("len") / 2), F.floor(F.col("len") / 3)
    pairs = [(zero, half), (F.col("len"), third), (one, F.col("len") + 1), (F.lit(-1), F.lit(2))]
    fields = variants.SCHEMAS["var"].lines
    lines = [F.struct(zero.alias("part"), records.format_line("c", fields["c"].fields, [F.lit(len(pairs)), name]).alias("value"))]
    lines += [
        F.struct(F.lit(i + 1).alias("part"), records.format_line("I", fields["I"].fields, list(pair)).alias("value"))
        for i, pair in enumerate(pairs)
    ]
    path = scratch_path(spark, "sites")
    written = reads.select("read_id", F.inline(F.array(*lines))).withColumn("group_id", F.col("read_id") + 1)
    records.write_records(written, ["read_id", "part"], variants.SCHEMAS["var"], path)
    return variants.read_sites(spark, path, contigs)


@query(
    "samples_read",
    f"""select row_number() over (order by source) as object_id, source as name, source||'.fa' as file_name,
sum(length({sql.clean('text')}))/1000.0::double as coverage from documents group by source""",
)
def samples_read(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    sources = docs.groupBy("source").agg((F.sum(F.length(bases(F.col("text")))) / F.lit(1000.0)).alias("coverage"))
    fields = variants.SCHEMAS["smp"].lines
    lines = F.array(
        F.struct(F.lit(0).alias("part"), records.format_line("N", fields["N"].fields, [F.col("source")]).alias("value")),
        F.struct(F.lit(1).alias("part"), records.format_line("F", fields["F"].fields, [F.concat("source", F.lit(".fa"))]).alias("value")),
        F.struct(F.lit(2).alias("part"), records.format_line("C", fields["C"].fields, [F.col("coverage")]).alias("value")),
    )
    path = scratch_path(spark, "samples")
    written = sources.select("source", F.inline(lines)).withColumn("group_id", F.lit(0))
    records.write_records(written, ["source", "part"], variants.SCHEMAS["smp"], path)
    return variants.read_samples(spark, path)
