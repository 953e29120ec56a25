"""How the shared tables stand in for sequence files.

``seq`` is the raw text: sampling drops non-bases by itself, and operators that
need letters take ``bases(seq)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequences import bases, unknown_as_a
from strandloom.params import SketchParams
from strandloom.plans.sql import PRIME
from strandloom.session import spread

DEFAULT = SketchParams(19, 31, 17)
DENSE = SketchParams(19, 5, 17)
SHORT = SketchParams(15, 7, 17)
LONG = SketchParams(31, 5, 17)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq"))
    return spread(reads, "read_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_id = F.col("conv_id") * 1000 + F.col("turn")
    reads = table(spark, sf_dir, "conversations").select(read_id.alias("read_id"), F.col("text").alias("seq"))
    return spread(reads, "read_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "pages").select(F.col("page_id").alias("read_id"), F.col("html").alias("seq"))
    return spread(reads, "read_id")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read_id"), F.col("text").alias("seq"))


def clean(reads: DataFrame) -> DataFrame:
    """Bases only, N read as A, with the length."""
    seq = unknown_as_a(bases(F.col("seq")))
    return reads.withColumn("seq", seq).withColumn("len", F.length("seq"))


def with_quality(reads: DataFrame) -> DataFrame:
    """Made-up qualities: ``(letter code + offset) mod 41`` at each base."""
    letters = F.filter(F.split("seq", ""), lambda c: c != "")
    return reads.withColumn("qual", F.transform(letters, lambda c, i: (F.ascii(c) + i) % 41))


def content(*columns: str) -> Column:
    """Sum of a hash of the integer columns over rows, as ``sql.content`` has it: reports on many rows carry it."""
    h = F.lit(0).cast("bigint")
    for column in columns:
        h = (h * 48271 + F.col(column).cast("bigint") % PRIME + PRIME) % PRIME
    return F.sum((h * h) % PRIME)
