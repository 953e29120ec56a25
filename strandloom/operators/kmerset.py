"""k-mer count tables.

A table has one row per canonical k-mer: ``kmer``, ``depth`` (saturating count),
``info`` (copy class and flags). ``first_read`` / ``first_pos`` are kept only where
first-insertion numbering is asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.functions import kmers as K
from strandloom.functions.sequences import bases, ratio, trim_linked_read
from strandloom.operators.sketch import sampled_kmers
from strandloom.params import SketchParams
from strandloom.session import with_ordinal


def count_kmers(reads: DataFrame, params: SketchParams, seq: str = "seq") -> DataFrame:
    """Distinct sampled k-mers with saturating depth.

    Counting is combined map-side, so the most frequent k-mer costs one row per
    task in the shuffle.
    """
    return count_hits(sampled_kmers(reads, params, seq, keep=(), emit=("kmer",)))


def count_hits(hits: DataFrame) -> DataFrame:
    """``count_kmers`` from k-mers that are sampled already."""
    counted = hits.groupBy("kmer").agg(K.saturated(F.count(F.lit(1))).alias("depth"))
    return counted.withColumn("info", F.lit(0))


def count_kmers_in_order(
    reads: DataFrame, params: SketchParams, seq: str = "seq", read_order: str = "read_id"
) -> DataFrame:
    """``count_kmers`` plus ``idx``: 1, 2, ... by first occurrence (read, position)."""
    hits = sampled_kmers(reads, params, seq, keep=(read_order,), emit=("kmer", "pos"))
    first = F.min(F.struct(F.col(read_order).alias("read"), "pos"))
    counted = hits.groupBy("kmer").agg(K.saturated(F.count(F.lit(1))).alias("depth"), first.alias("first"))
    ranked = with_ordinal(counted, [F.col("first.read"), F.col("first.pos")], "idx", start=1)
    return ranked.select("idx", "kmer", "depth", F.lit(0).alias("info"))


def linked_reads(reads: DataFrame, order: str = "read_id", seq: str = "seq") -> DataFrame:
    """Trim the barcode of every other read, counting reads in ``order``."""
    numbered = with_ordinal(reads.select(order, bases(F.col(seq)).alias("seq")), [order], "_ord", start=1)
    return numbered.select(order, trim_linked_read(F.col("seq"), F.col("_ord")).alias("seq"))


def add_summary(reads: DataFrame, table: DataFrame, params: SketchParams, seq: str = "seq") -> DataFrame:
    """Totals reported after adding reads: sequences, bases, sampled k-mers, table size."""
    per_read = reads.select(
        F.lit(1).alias("n_seq"), F.length(bases(F.col(seq))).alias("tot_len"), F.lit(0).alias("tot_hash"), F.lit(0).alias("n_kmers")
    )
    hashes = sampled_kmers(reads, params, seq, keep=(), emit=("kmer",))
    per_hash = hashes.select(F.lit(0).alias("n_seq"), F.lit(0).alias("tot_len"), F.lit(1).alias("tot_hash"), F.lit(0).alias("n_kmers"))
    per_kmer = table.select(F.lit(0).alias("n_seq"), F.lit(0).alias("tot_len"), F.lit(0).alias("tot_hash"), F.lit(1).alias("n_kmers"))
    parts = per_read.unionByName(per_hash).unionByName(per_kmer)
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns])


def depth_histogram(table: DataFrame) -> DataFrame:
    return table.groupBy("depth").agg(F.count(F.lit(1)).alias("n_kmers"))


def summarize(table: DataFrame) -> DataFrame:
    """Entries, total count, mean depth, N50 depth and copy class counts (one row)."""
    by_depth = table.groupBy("depth").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum((K.copy_class(F.col("info")) == c).cast("int")).alias(f"copy{c}") for c in range(4)],
    )
    # At most 65536 depths exist, so one task holds the cumulative histogram.
    upto = W.orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy()
    weight = F.col("depth") * F.col("n")
    walked = by_depth.withColumn("cum", F.sum(weight).over(upto)).withColumn("tot", F.sum(weight).over(whole))
    past_half = F.col("cum") > F.floor(F.col("tot") / 2)
    return walked.agg(
        F.sum("n").alias("n_kmers"),
        F.sum(weight).alias("total_count"),
        ratio(F.sum(weight), F.sum("n")).alias("mean_depth"),
        F.min(F.when(past_half, F.col("depth"))).alias("n50_depth"),
        *[F.coalesce(F.sum(f"copy{c}"), F.lit(0)).alias(f"copy{c}") for c in range(4)],
    )


def prune(table: DataFrame, min_depth: int, max_depth: int = 0) -> DataFrame:
    """Keep ``min_depth <= depth < max_depth`` (0: no upper limit)."""
    kept = F.col("depth") >= min_depth
    return table.where(kept & (F.col("depth") < max_depth) if max_depth else kept)


def reindex(table: DataFrame) -> DataFrame:
    """Renumber ``idx`` from 1 in its old order."""
    return with_ordinal(table.withColumnRenamed("idx", "_old"), ["_old"], "idx", start=1).drop("_old")


def set_copy(table: DataFrame, single: int, double: int, many: int) -> DataFrame:
    """Copy class by depth thresholds: below ``single`` 0, below ``double`` 1, below ``many`` 2, else 3."""
    depth = F.col("depth")
    copy = F.when(depth < single, 0).when(depth < double, 1).when(depth < many, 2).otherwise(K.COPY_MANY)
    return table.withColumn("info", K.with_copy(F.col("info"), copy))


def set_copy_many(table: DataFrame, many: int) -> DataFrame:
    """Copy class 3 from depth ``many`` on, others unchanged."""
    return table.withColumn("info", K.with_flag(F.col("info"), K.COPY_MANY, F.col("depth") >= many))


def merge(left: DataFrame, right: DataFrame, left_params: SketchParams, right_params: SketchParams) -> DataFrame:
    """Add ``right`` into ``left``.

    Depths add up and saturate. Where ``right`` has the k-mer, the info becomes
    the left copy class OR-ed with the capped sum of both copy classes and other
    flags are cleared; k-mers only in ``left`` keep their info.
    """
    if not left_params.compatible(right_params):
        raise ValueError("k-mer tables differ in k, w or seed")
    sides = left.select("kmer", "depth", "info", F.lit(0).alias("side")).unionByName(
        right.select("kmer", "depth", "info", F.lit(1).alias("side"))
    )
    merged = sides.groupBy("kmer").agg(
        K.saturated(F.sum("depth")).alias("depth"),
        F.coalesce(F.max(F.when(F.col("side") == 0, F.col("info"))), F.lit(0)).alias("left_info"),
        F.max(F.when(F.col("side") == 1, F.col("info"))).alias("right_info"),
    )
    left_copy = K.copy_class(F.col("left_info"))
    total = F.least(left_copy + K.copy_class(F.col("right_info")), F.lit(3))
    info = F.when(F.col("right_info").isNull(), F.col("left_info")).otherwise(left_copy.bitwiseOR(total))
    return merged.select("kmer", "depth", info.alias("info"))


def add_counts(table: DataFrame, counts: DataFrame) -> DataFrame:
    """Count more reads into a table: depths add up and saturate, known k-mers keep their info."""
    both = table.select("kmer", "depth", "info").unionByName(counts.select("kmer", "depth", F.lit(0).alias("info")))
    return both.groupBy("kmer").agg(K.saturated(F.sum("depth")).alias("depth"), F.max("info").alias("info"))


def compare_depths(table: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Depth of every k-mer of ``table`` in each other table, 0 where absent."""
    base = table.select("kmer", K.copy_class(F.col("info")).alias("copy"), "depth")

    def attach(frame: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        name, other = item
        return frame.join(other.select("kmer", F.col("depth").alias(name)), "kmer", "left")

    joined = reduce(attach, others.items(), base)
    return joined.select("kmer", "copy", "depth", *[F.coalesce(n, F.lit(0)).alias(n) for n in others])
