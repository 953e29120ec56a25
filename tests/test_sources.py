import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandloom.sources.lines import read_lines, running_counts
from strandloom.sources import kmer_tables, records, sequence_files, variants
from strandloom.params import SketchParams

READS = [(1, "r1", "first read", "ACGTNacgt", [1, 2, 3, 4, 5, 6, 7, 8, 9]), (2, "r2", "", "GGGG", [40, 0, 93, 7]), (3, "r3", "x", "T", [9])]


@pytest.fixture
def reads(spark):
    return spark.createDataFrame(READS, "read_id long, name string, desc string, seq string, qual array<int>")


def _plain(frame, *columns):
    return [tuple(r) for r in frame.orderBy("read_id").select("read_id", *columns).collect()]


@pytest.mark.parametrize("name", ["a.fq", "a.fq.gz", "a.parquet"])
def test_quality_formats(spark, reads, tmp_path, name):
    path = str(tmp_path / name)
    sequence_files.write_sequences(reads, path)
    assert _plain(sequence_files.read_sequences(spark, path), "name", "desc", "seq", "qual") == READS


def test_records_and_fasta(spark, reads, tmp_path):
    path = str(tmp_path / "a.rec")
    sequence_files.write_sequences(reads, path)
    assert _plain(sequence_files.read_sequences(spark, path), "name", "seq", "qual") == [(r[0], r[1], r[3], r[4]) for r in READS]
    sequence_files.convert(spark, path, str(tmp_path / "b.fa"))
    assert _plain(sequence_files.read_sequences(spark, str(tmp_path / "b.fa")), "name", "seq") == [(r[0], r[1], r[3]) for r in READS]
    with pytest.raises(ValueError):
        sequence_files.write_sequences(reads, str(tmp_path / "c.parquet.gz"))


def test_foreign_fasta(spark, tmp_path):
    text = ">s1 some words\r\nACG\r\nT N-*\r\n>s2\nac>gt\n>s3\tdesc\n"
    (tmp_path / "x.fa").write_text(text)
    with gzip.open(tmp_path / "y.fa.gz", "wt") as out:
        out.write(text)
    want = [(1, "s1", "some words", "ACGTN"), (2, "s2", "", "acgt"), (3, "s3", "desc", "")]
    for name in ("x.fa", "y.fa.gz"):
        assert _plain(sequence_files.read_sequences(spark, str(tmp_path / name)), "name", "desc", "seq") == want


def test_file_order_gives_ids(spark, tmp_path):
    for n in range(6):
        (tmp_path / f"part{n}.fa").write_text("".join(f">f{n}_{i}\nACGT\n" for i in range(n + 1)))
    names = [r.name for r in sequence_files.read_fasta(spark, str(tmp_path)).orderBy("read_id").collect()]
    assert names == [f"f{n}_{i}" for n in range(6) for i in range(n + 1)]


def test_uneven_fastq_fails(spark, tmp_path):
    (tmp_path / "bad.fq").write_text("@a\nACGT\n+\n!!!\n")
    with pytest.raises(Exception, match="differ in length"):
        sequence_files.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_sam_orientation(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\n@SQ\tSN:c\nq1\t0\tc\t1\t9\t4M\t*\t0\t0\tACGG\t!\"#$\nq2\t16\tc\t1\t9\t4M\t*\t0\t0\tARGG\t!\"#$\n")
    rows = _plain(sequence_files.read_sequences(spark, str(tmp_path / "x.sam")), "name", "seq", "qual")
    assert rows == [(1, "q1", "ACGG", [0, 1, 2, 3]), (2, "q2", "CCYT", [3, 2, 1, 0])]


def test_unknown_and_empty(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hello\n")
    (tmp_path / "e.txt").write_text("")
    for name in ("x.txt", "e.txt"):
        with pytest.raises(ValueError):
            sequence_files.sniff(spark, str(tmp_path / name))


def test_kmer_text(spark, tmp_path):
    p = SketchParams(5, 3, 42)
    table = spark.createDataFrame([(1, 27, 4, 1), (2, 1023, 9, 0)], "idx long, kmer long, depth int, info int")
    kmer_tables.write_text(table, p, str(tmp_path / "t"))
    lines = [line for part in sorted((tmp_path / "t").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines == ["modset bits 28 size 3 k 5 w 3 seed 42", "1\taacgt\t4\t1", "2\tttttt\t9\t0"]
    back, q = kmer_tables.read_text(spark, str(tmp_path / "t"))
    assert q == p and sorted(back.collect()) == sorted(table.collect())
    kmer_tables.write_table(table, p, str(tmp_path / "p"))
    assert kmer_tables.read_table(spark, str(tmp_path / "p"))[1] == p


def test_record_header(spark, reads, tmp_path):
    header = records.Header((("prog", "1.0", "cmd with words", "2024-01-01_00:00:00"),), (("ref file.fa", 3),), ("later.fa",))
    path = str(tmp_path / "h.rec")
    records.write_sequence_records(reads, path, header=header)
    assert records.read_header(spark, path) == header
    assert records.Header((("x", "", "", ""),)).inherit(header).provenance[0][0] == "prog"
    assert records.embedded_schema(spark, path).lines == records.SEQUENCE_SCHEMA.lines
    lines = [line for part in sorted((tmp_path / "h.rec").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines[0] == "1 3 seq 1 0" and "# S 3" in lines and "@ S 9" in lines and "+ S 14" in lines


def test_bad_schemas():
    for text in ("P 3 abc\nO A 1 4 WHAT\n", "P 3 abc\nO A 2 6 STRING 3 DNA\n", "P 3 abc\nO A 0\nO B 0\n"):
        with pytest.raises(ValueError):
            records.parse_schema(text)


def test_comments_after_fields(spark, tmp_path):
    (tmp_path / "c.rec").write_text("1 3 abc 1 0\n~ O A 2 3 INT 8 INT_LIST\n.\nA 7 2 5 6 a comment\nA -1 0\n")
    lines = records.read_records(spark, str(tmp_path / "c.rec"))
    schema = records.embedded_schema(spark, str(tmp_path / "c.rec"))
    rows = records.parse_lines(lines, schema, "A").orderBy("line_no").select("f0", "f1").collect()
    assert [tuple(r) for r in rows] == [(7, [5, 6]), (-1, [])]


def test_sites_and_samples(spark, tmp_path):
    contigs = spark.createDataFrame([("c1", 50), ("c2", 10)], "name string, len int")
    head = "1 3 var 1 0\n~ G c 2 3 INT 6 STRING\n~ O I 2 3 INT 3 INT\n"
    (tmp_path / "s.rec").write_text(head + "c 1 2 c1\nI 3 9\nc 1 2 c9\nI 1 2\n")
    sites = variants.read_sites(spark, str(tmp_path / "s.rec"), contigs)
    assert sorted((r.left_pos, r.status) for r in sites.collect()) == [(1, "unknown contig"), (3, "ok")]
    with pytest.raises(Exception, match="unknown contig"):
        variants.valid_sites(sites).collect()
    with pytest.raises(Exception, match="duplicate"):
        variants.check_unique_names(contigs.union(contigs)).collect()
    smp = "1 3 smp 1 0\n~ O N 1 6 STRING\n~ D F 1 6 STRING\n"
    (tmp_path / "n.rec").write_text(smp + "N 1 a\nF 3 a.x\nN 1 a\n")
    with pytest.raises(Exception, match="duplicate sample"):
        variants.read_samples(spark, str(tmp_path / "n.rec")).collect()


def test_numbering_across_splits(spark, tmp_path):
    """Small splits cut files anywhere; ids still follow file order."""
    rng = random.Random(3)
    want = []
    for n in range(3):
        rows = [(f"f{n}_{i}", "ACGT"[i % 4] * rng.randrange(1, 90)) for i in range(60)]
        (tmp_path / f"p{n}.fa").write_text("".join(f">{name}\n{seq}\n" for name, seq in rows))
        want += rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        frame = sequence_files.read_fasta(spark, str(tmp_path))
        assert frame.rdd.getNumPartitions() > 6
        got = [(r.read_id, r.name, r.seq) for r in frame.orderBy("read_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i + 1, name, seq) for i, (name, seq) in enumerate(want)]


def test_running_counts_across_splits_and_batches(spark, tmp_path):
    rng, want, total = random.Random(9), [], [0, 0]
    for n in range(3):
        rows = [rng.choice("AB") + " " * rng.randrange(40) + f"{n}_{i}" for i in range(300)]
        (tmp_path / f"p{n}.txt").write_text("\n".join(rows) + "\n")
        for row in rows:
            total = [total[0] + 1, total[1] + (row[0] == "A")]
            want.append((row, *total))
    settings = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "64", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        lines = read_lines(spark, str(tmp_path))
        frame = running_counts(lines, {"a": F.lit(1), "b": (F.substring("value", 1, 1) == "A").cast("int")})
        got = [tuple(r) for r in frame.orderBy("a").collect()]
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert got == want


def test_fastq_records_across_split_borders(spark, tmp_path):
    """One file read in splits of a few bytes; qualities start with the header's mark."""
    reads = [(f"r{i}", "ACGT"[i % 4] * (1 + 37 * i % 90)) for i in range(60)]
    path = tmp_path / "one.fq"
    path.write_text("".join(f"@{name} d{i}\n{seq}\n+\n{'@' * len(seq)}\n" for i, (name, seq) in enumerate(reads)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("7", "64", "333", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = sequence_files.read_fastq(spark, str(path))
            rows = sorted((r["read_id"], r["name"], r["desc"], r["seq"], set(r["qual"])) for r in found.collect())
            assert rows == [(i + 1, name, f"d{i}", seq, {31}) for i, (name, seq) in enumerate(reads)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_fastq_text_is_not_shuffled(spark, tmp_path):
    path = tmp_path / "some.fq"
    path.write_text("@a\nACGT\n+\nIIII\n" * 50)
    found = sequence_files.read_fastq(spark, str(path))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 50


RECORD_HEAD = "1 3 abc 1 0\n~ G g 2 3 INT 6 STRING\n~ O A 2 3 INT 8 INT_LIST\n~ D W 2 11 STRING_LIST 3 INT\n~ D T 2 6 STRING 4 REAL\n.\n"


def _grouped_records(n, seed):
    """Lines and the expected rows (line_no, object_id, group_id, A, W, T, group) of each object."""
    rng, lines, want, group, group_id = random.Random(seed), [], [], None, 0
    for i in range(1, n + 1):
        if rng.random() < 0.2:
            group_id += 1
            group = (i, f"group {i}")
            lines.append(f"g {i} {len(group[1])} {group[1]}")
        ints = [rng.randrange(-9, 99) for _ in range(rng.randrange(4))]
        lines.append(f"A {i} {len(ints)}" + "".join(f" {x}" for x in ints) + rng.choice(["", " a comment"]))
        row = [len(lines), i, group_id, (i, ints), None, None, group]
        if rng.random() < 0.7:
            words = [rng.choice(["", "x y", "long word"]) for _ in range(rng.randrange(3))]
            lines.append(f"W {len(words)}" + "".join(f" {len(w)} {w}" for w in words) + f" {i}")
            row[4] = (words, i)
        if rng.random() < 0.7:
            text = rng.choice(["", "some text ", "t"])
            lines.append(f"T {len(text)} {text} {i / 4}")
            row[5] = (text, i / 4)
        want.append(tuple(row))
    return lines, want


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "600", "spark.sql.files.openCostInBytes": "64", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def _plain_struct(value):
    return value if value is None else tuple(value)


def test_objects_of_all_types_in_one_pass(spark, tmp_path, small_splits):
    """Splits and Arrow batches border anywhere; objects before the first group have none."""
    lines, want = _grouped_records(200, 5)
    assert want[0][6] is None
    (tmp_path / "r.rec").write_text(RECORD_HEAD + "\n".join(lines) + "\n")
    schema = records.embedded_schema(spark, str(tmp_path / "r.rec"))
    found = records.read_records(spark, str(tmp_path / "r.rec"), schema, group_line=True)
    frame = records.objects(found, schema, a="A", w="W", t="T", g="g")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") + plan.count("MapInArrow") == 2
    rows = [(r.line_no, r.object_id, r.group_id, *map(_plain_struct, (r.a, r.w, r.t, r.g))) for r in frame.orderBy("object_id").collect()]
    assert rows == want
    with pytest.raises(ValueError):
        records.objects(records.read_records(spark, str(tmp_path / "r.rec"), schema), schema, g="g")


def test_index_opens_only_the_files_of_an_object(spark, tmp_path, small_splits):
    """Bytes read for one object or group do not depend on the size of the whole."""
    read = {}
    for n in (120, 600):
        lines, want = _grouped_records(n, 8)
        path = tmp_path / f"r{n}"
        path.mkdir()
        step = 23
        for k in range(0, len(lines), step):
            (path / f"p{k // step:04}.rec").write_text((RECORD_HEAD if k == 0 else "") + "\n".join(lines[k : k + step]) + "\n")
        records.write_index(spark, str(path))
        whole = records.read_records(spark, str(path), group_line=True).toPandas()
        groups = [w[2] for w in want]
        files = set()
        for name, ids in (("object_id", (1, 9, n // 2, n + 1)), ("group_id", (1, 7, groups[-1]))):
            for i in ids:
                found = records.read_indexed(spark, str(path), **{name: i})
                columns = ["line_no", "line_type", "value", "object_id", "group_id"]
                expected = whole[whole[name] == i].sort_values("line_no")
                assert [tuple(r) for r in found.select(columns).orderBy("line_no").collect()] == [tuple(r) for r in expected[columns].values]
                assert {r.group_line for r in found.collect()} == set(expected["group_line"])
                used = found.inputFiles() if len(expected) else []
                assert len(used) <= 3
                files.update([(name, i, len(used))] if i < 10 else [])
        read[n] = files
    assert read[120] == read[600]
    (tmp_path / "r120" / "p0000.rec").write_text(RECORD_HEAD + "A 1 0\n")
    with pytest.raises(ValueError, match="changed"):
        records.read_indexed(spark, str(tmp_path / "r120"), object_id=1)


def test_small_record_files(spark, tmp_path):
    reads = spark.range(1, 500).select(F.col("id").alias("read_id"), F.lit(0).alias("group_id"), F.concat(F.lit("S 1 A"), F.lit("")).alias("value"))
    records.write_records(reads, ["read_id"], records.SEQUENCE_SCHEMA, str(tmp_path / "s"), lines_per_file=20)
    assert len(list((tmp_path / "s").glob("part-*"))) >= 20
    records.write_index(spark, str(tmp_path / "s"))
    found = records.read_indexed(spark, str(tmp_path / "s"), object_id=333)
    assert len(found.inputFiles()) == 1 and [r.line_no for r in found.collect()] == [333]
