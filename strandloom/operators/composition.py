"""Base, quality and length statistics of a read table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.functions import kernel
from strandloom.functions.sequences import ALPHABETS, length_bin, percent, ratio


def byte_histogram(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """Occurrences of each byte: one partial histogram per batch, then a sum by byte."""
    partial = reads.select(seq).mapInArrow(kernel.byte_counter(seq), "byte int, n bigint")
    return partial.groupBy("byte").agg(F.sum("n").alias("n"))


def base_composition(reads: DataFrame, seq: str = "seq", letters: str = ALPHABETS["text"]["from"]) -> DataFrame:
    """Count and percentage of each accepted letter present."""
    accepted = byte_histogram(reads, seq).where(F.col("byte").isin(*[ord(c) for c in letters]))
    # One row per letter is left, so the total is taken in a single task.
    total = F.sum("n").over(W.partitionBy())
    return accepted.select(F.char("byte").alias("base"), "n", percent(F.col("n"), total).alias("pct"))


def quality_histogram(reads: DataFrame, qual: str = "qual") -> DataFrame:
    """Count, percentage and cumulative percentage of each quality value."""
    binned = reads.select(F.explode(qual).alias("qual")).groupBy("qual").agg(F.count(F.lit(1)).alias("n"))
    # A quality is one byte, so at most 256 rows reach the single window task.
    total = F.sum("n").over(W.partitionBy())
    upto = F.sum("n").over(W.orderBy("qual").rowsBetween(W.unboundedPreceding, 0))
    return binned.select("qual", "n", percent(F.col("n"), total).alias("pct"), percent(upto, total).alias("cum_pct"))


def length_summary(reads: DataFrame, length: str = "len") -> DataFrame:
    """Sequence count and total, mean, least (empty ones ignored) and greatest length."""
    return reads.agg(
        F.count(F.lit(1)).alias("n_seq"),
        F.sum(length).alias("total"),
        ratio(F.sum(length), F.count(F.lit(1))).alias("mean"),
        F.min(F.when(F.col(length) > 0, F.col(length))).alias("min_len"),
        F.max(length).alias("max_len"),
    )


def _length_bins(reads: DataFrame, length: str) -> DataFrame:
    """Reads and bases per quadratic bin; under half a million bins for any 32-bit length."""
    binned = reads.groupBy(length_bin(F.col(length)).alias("bin"))
    return binned.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(length).alias("bases"),
        F.min(F.when(F.col(length) > 0, F.col(length))).alias("lo"),
        F.max(length).alias("hi"),
    )


def length_n50(reads: DataFrame, length: str = "len") -> DataFrame:
    """Approximate N50: first bin at which the cumulative bases reach half of all bases."""
    upto = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    walked = _length_bins(reads, length).select(
        "*", F.sum("bases").over(upto).alias("cum"), F.sum("bases").over(W.partitionBy()).alias("total")
    )
    reached = F.min(F.when(2 * F.col("cum") >= F.col("total"), F.col("bin"))) + 1
    found = walked.agg(reached.cast("bigint").alias("i"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return found.where("lo < hi").select(F.floor(F.col("i") * (F.col("i") + 1) / 100).cast("bigint").alias("n50"))


def length_distribution(reads: DataFrame, rows: int = 20, length: str = "len") -> DataFrame:
    """About ``rows`` groups of quadratic bins, each labelled by its last bin's lower edge."""
    bins = _length_bins(reads, length).withColumn("top", F.max("bin").over(W.partitionBy()))
    step = F.greatest(F.lit(1), F.floor((F.col("top") + 1) / rows)).cast("int")
    last = F.col("top") - F.floor((F.col("top") - F.col("bin")) / step).cast("int") * step
    grouped = bins.withColumn("last", last).groupBy("last").agg(F.sum("n").alias("n"))
    edge = F.floor(F.col("last").cast("bigint") * F.col("last") / 100).cast("bigint")
    return grouped.select(edge.alias("length_from"), "n")
