"""FASTA, FASTQ, SAM text and Parquet read tables.

A read table has ``read_id`` (1, 2, ... in file order), ``name``, ``desc``,
``seq`` and, where the format has them, ``qual`` (integers).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequences import (
    complement_iupac,
    convert_alphabet,
    quality_text,
    quality_values,
)
from strandloom.session import stored
from strandloom.sources.lines import head_lines, number, placed, read_lines, write_lines

# SAM header record types and the flag bit of a reverse-strand record.
SAM_HEADERS = ("@HD", "@SQ", "@RG", "@PG", "@CO")
SAM_REVERSE = 16


def _name_and_description(header: Column) -> tuple[Column, Column]:
    return F.regexp_extract(header, r"^(\S*)", 1), F.regexp_extract(header, r"^\S*\s+(.*)$", 1)


def sniff(spark: SparkSession, path: str) -> str:
    """Format by the first line: fasta, fastq, sam, records or parquet."""
    if path.rstrip("/").endswith(".parquet"):
        return "parquet"
    line = next(head_lines(spark, path), None)
    if line is None:
        raise ValueError(f"empty sequence file {path}")
    if line.startswith(">"):
        return "fasta"
    if line.startswith(SAM_HEADERS) and line[3:4] == "\t":
        return "sam"
    if line.startswith("@"):
        return "fastq"
    if line.startswith("1 "):
        return "records"
    raise ValueError(f"unknown sequence format in {path}")


def read_fasta(spark: SparkSession, path: str, alphabet: str = "text") -> DataFrame:
    """Records are split at line starts with '>', so a file is read in parallel."""
    records = number(read_lines(spark, path, "\n>"), "read_id", start=1)
    text = F.regexp_replace("value", "^>", "")
    header = F.regexp_replace(F.substring_index(text, "\n", 1), "\r$", "")
    body = F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise("")
    name, desc = _name_and_description(header)
    return records.select(
        "read_id", name.alias("name"), desc.alias("desc"), convert_alphabet(body, alphabet).alias("seq")
    )


def _four_line_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from numbered lines (line_no, _rank, value) of a scan partition, by the split in which they begin.

    Lines at the start of a split that belong to an earlier one's last record are passed over, and what
    the own last record lacks stays null.
    """
    names = ["line_no", "_rank", "value"]
    rest = None

    def emit(lines: pa.Table, heads: np.ndarray) -> pa.RecordBatch:
        value, record = lines.column(2).combine_chunks(), lines.column(0).to_numpy() // 4
        columns = [pa.array(record[heads], pa.int64()), value.take(pa.array(heads))]
        for k in (1, 3):
            at = np.minimum(heads + k, len(record) - 1)
            there = (heads + k < len(record)) & (record[at] == record[heads])
            columns.append(value.take(pa.array(at, mask=~there)))
        return pa.RecordBatch.from_arrays(columns, names=["record", "header", "seq", "quality"])

    for batch in batches:
        lines = pa.Table.from_arrays([c if not pa.types.is_large_string(c.type) else c.cast(pa.string()) for c in batch.columns], names=names)
        line_no, rank = lines.column(0).to_numpy(), lines.column(1).to_numpy()
        lines = lines.filter(pa.array(rank >= line_no % 4))
        lines = pa.concat_tables([rest, lines]) if rest is not None else lines
        if not len(lines):
            continue
        heads = np.flatnonzero(lines.column(0).to_numpy() % 4 == 0)
        # The last record may go on in the next batch.
        rest = lines.slice(int(heads[-1]))
        if len(heads) > 1:
            yield emit(lines.slice(0, int(heads[-1])), heads[:-1])
    if rest is not None:
        yield emit(rest, np.zeros(1, np.int64))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Four-line records; sequence and quality must be equally long.

    The number of lines before a split tells where its records begin, though a quality may start with the
    header's mark. So records are put together where their lines are scanned; only lines behind
    a split's border, at most three per split, move to the record that began before it.
    """
    lines = placed(read_lines(spark, path), "line_no").select("line_no", "_rank", "value")
    began = lines.mapInArrow(_four_line_records, "record bigint, header string, seq string, quality string")
    part = F.col("line_no") % 4
    over = lines.where(F.col("_rank") < part).groupBy(F.floor(F.col("line_no") / 4).cast("bigint").alias("_record")).agg(
        F.max(F.when(part == 1, F.col("value"))).alias("_seq"), F.max(F.when(part == 3, F.col("value"))).alias("_quality")
    )
    whole = began.join(stored(over, "border-lines"), F.col("record") == F.col("_record"), "left")
    seq, quality = F.coalesce("seq", "_seq"), F.coalesce("quality", "_quality")
    records = whole.select("record", "header", seq.alias("seq"), quality.alias("quality"))
    name, desc = _name_and_description(F.regexp_replace("header", "^@", ""))
    uneven = F.coalesce(F.length("seq"), F.lit(-1)) != F.coalesce(F.length("quality"), F.lit(-1))
    problem = F.concat(F.lit("quality and sequence differ in length in "), F.coalesce("header", F.lit("a short record")))
    return records.select(
        (F.col("record") + 1).alias("read_id"),
        name.alias("name"),
        desc.alias("desc"),
        F.when(uneven, F.raise_error(problem).cast("string")).otherwise(F.col("seq")).alias("seq"),
        quality_values(F.col("quality")).alias("qual"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text; reverse-strand records are turned back to read orientation."""
    # Header lines only open a file, so the others stay contiguous.
    lines = read_lines(spark, path).where(~F.col("value").rlike(r"^@[A-Z][A-Z]\t"))
    ordered = number(lines, "read_id", start=1)
    field = F.split("value", "\t")
    fields = ordered.select(
        "read_id",
        field[0].alias("name"),
        field[1].cast("int").alias("flag"),
        field[9].alias("seq"),
        quality_values(field[10]).alias("qual"),
    )
    is_reverse = F.col("flag").bitwiseAND(F.lit(SAM_REVERSE)) != 0
    return fields.select(
        "read_id",
        "name",
        F.lit("").alias("desc"),
        F.when(is_reverse, F.reverse(complement_iupac(F.col("seq")))).otherwise(F.col("seq")).alias("seq"),
        F.when(is_reverse, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"),
    )


def _header(mark: str) -> Column:
    has_desc = F.coalesce(F.length("desc"), F.lit(0)) > 0
    return F.concat(F.lit(mark), F.col("name"), F.when(has_desc, F.concat(F.lit(" "), F.col("desc"))).otherwise(""))


def fasta_text(reads: DataFrame) -> DataFrame:
    """``read_id`` and the two-line record as ``value``."""
    return reads.select("read_id", F.concat(_header(">"), F.lit("\n"), "seq").alias("value"))


def fastq_text(reads: DataFrame) -> DataFrame:
    """``read_id`` and the four-line record as ``value``; missing qualities become '!'."""
    qual = F.col("qual") if "qual" in reads.columns else F.lit(None).cast("array<int>")
    quality = quality_text(qual, F.length("seq"))
    return reads.select("read_id", F.concat(_header("@"), F.lit("\n"), "seq", F.lit("\n+\n"), quality).alias("value"))


def read_sequences(spark: SparkSession, path: str, alphabet: str = "text") -> DataFrame:
    """Read any of the formats; ``alphabet`` says which letters of a FASTA file count."""
    from strandloom.sources.records import read_sequence_records

    readers = {
        "fasta": lambda session, source: read_fasta(session, source, alphabet),
        "fastq": read_fastq,
        "sam": read_sam,
        "records": read_sequence_records,
        "parquet": lambda session, source: session.read.parquet(source),
    }
    return readers[sniff(spark, path)](spark, path)


def write_sequences(reads: DataFrame, path: str, kind: str | None = None) -> None:
    """Write by ``kind`` or suffix: .fa/.fq (optionally .gz), .rec, otherwise Parquet."""
    from strandloom.sources.records import write_sequence_records

    stem = path.rstrip("/")
    gzip = stem.endswith(".gz")
    stem = stem.removesuffix(".gz")
    suffix = stem.rsplit(".", 1)[-1]
    kind = kind or {"fa": "fasta", "fasta": "fasta", "fq": "fastq", "fastq": "fastq", "rec": "records"}.get(suffix, "parquet")
    if kind == "fasta":
        write_lines(fasta_text(reads), ["read_id"], path, gzip)
    elif kind == "fastq":
        write_lines(fastq_text(reads), ["read_id"], path, gzip)
    elif kind == "records":
        write_sequence_records(reads, path, gzip)
    elif gzip:
        raise ValueError("gzip applies to text formats only")
    else:
        reads.write.mode("overwrite").parquet(path)


def convert(spark: SparkSession, source: str, target: str, kind: str | None = None) -> None:
    write_sequences(read_sequences(spark, source, "letters"), target, kind)
