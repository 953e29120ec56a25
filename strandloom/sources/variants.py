"""Insertion sites and sample lists kept as typed record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.records import objects, parse_schema, read_records, typed_lines

# Line types of site and sample files.
SCHEMAS = parse_schema(
    """P 3 var
S 3 ins
G c 2 3 INT 6 STRING
O I 2 3 INT 3 INT
D A 1 4 CHAR
D G 1 6 STRING
D K 2 4 CHAR 3 DNA
D k 2 4 CHAR 3 DNA
D L 1 8 INT_LIST
D R 1 8 INT_LIST
D F 1 8 INT_LIST
P 3 smp
O N 1 6 STRING
D F 1 6 STRING
D C 1 4 REAL
"""
)


def check_unique_names(contigs: DataFrame, name: str = "name") -> DataFrame:
    """Contigs with an error raised on a repeated name."""
    message = F.concat(F.lit("duplicate name "), F.col(name))
    counted = contigs.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.max("len").alias("len"))
    checked = F.when(F.col("_n") > 1, F.raise_error(message).cast("string")).otherwise(F.col(name))
    return counted.select(checked.alias(name), "len")


def read_sites(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """Sites with their contig and a ``status``: ok or the rule they break.

    ``contigs`` has ``name`` and ``len``. The contig line before a site sets its
    contig; it is carried along by the reader.
    """
    schema = SCHEMAS["var"]
    lines = typed_lines(read_records(spark, path, schema, group_line=True), schema, contig="c", site="I")
    sites = lines.where(F.col("line_type") == "I").select(
        "object_id", F.col("contig.f1").alias("chrom"), F.col("site.f0").alias("left_pos"), F.col("site.f1").alias("right_pos")
    )
    named = sites.join(
        contigs.select(F.col("name").alias("chrom"), "len"), "chrom", "left"
    )
    status = (
        F.when(F.col("len").isNull(), "unknown contig")
        .when(F.col("left_pos") >= F.col("right_pos"), "positions out of order")
        .when(F.col("left_pos") < 0, "left position below 0")
        .when(F.col("right_pos") > F.col("len"), "right position past the end")
        .otherwise("ok")
    )
    return named.select("object_id", "chrom", "left_pos", "right_pos", status.alias("status"))


def valid_sites(sites: DataFrame) -> DataFrame:
    """Sites with an error raised on the first broken rule."""
    message = F.concat_ws(" ", F.col("status"), F.lit("at site"), F.col("object_id"))
    chrom = F.when(F.col("status") == "ok", F.col("chrom")).otherwise(F.raise_error(message).cast("string"))
    return sites.select("object_id", chrom.alias("chrom"), "left_pos", "right_pos")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample name, file name and coverage per object; a repeated name is an error."""
    schema = SCHEMAS["smp"]
    found = objects(read_records(spark, path, schema), schema, name="N", file="F", coverage="C")
    rows = found.select("object_id", F.col("name.f0").alias("N"), F.col("file.f0").alias("F"), F.col("coverage.f0").alias("C"))
    seen = rows.groupBy("N").agg(F.count(F.lit(1)).alias("_n"))
    message = F.concat(F.lit("duplicate sample name "), F.col("N"))
    name = F.when(F.col("_n") > 1, F.raise_error(message).cast("string")).otherwise(F.col("N"))
    return rows.join(seen, "N").select(
        "object_id", name.alias("name"), F.col("F").alias("file_name"), F.col("C").alias("coverage")
    )
