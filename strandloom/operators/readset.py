"""Reads as ordered k-mer hits, their statistics and within-read k-mer flags.

Windows here are per read. A read arrives as one row, so its hits are bounded by
what a single task already had to hold; k-mer keys, which are not bounded, only
meet map-side combined aggregates or ``lookup``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.functions import kmers as K
from strandloom.functions.sequences import bases
from strandloom.operators.sketch import sampled_kmers
from strandloom.params import SketchParams
from strandloom.session import lookup, stored


def _by_pos():
    return W.partitionBy("read_id").orderBy("pos")


@dataclass(frozen=True)
class Readset:
    """``reads`` (read_id, len), all sampled ``seeds`` (read_id, len, kmer, is_fwd, pos and,
    for k-mers of the table, depth, info and n_hits) and the k-mer ``table`` with depths
    recounted from the reads. ``depth`` saturates, ``n_hits`` does not: it sizes what hot k-mers are split into."""

    reads: DataFrame
    seeds: DataFrame
    table: DataFrame
    params: SketchParams

    @property
    def hits(self) -> DataFrame:
        """Seeds whose k-mer is in the table."""
        return self.seeds.where(F.col("info").isNotNull())

    def materialized(self) -> "Readset":
        """Keep the seeds as a stored table for analyses that read them several times."""
        return replace(self, seeds=stored(self.seeds, "hits"))


def sampled(reads: DataFrame, params: SketchParams) -> DataFrame:
    """The sampled k-mers of all reads as a stored table: the text is read and sampled once."""
    return stored(sampled_kmers(reads, params, emit=("kmer", "is_fwd", "pos", "len")), "seeds")


def load(reads: DataFrame, table: DataFrame, params: SketchParams, seeds: DataFrame | None = None) -> Readset:
    """Find each read's hits to k-mers of ``table``; depth is recounted from the reads.

    ``seeds`` (from ``sampled``) are made here if they are not given. The recounted table is checkpointed:
    it is far smaller than the reads and every later step looks k-mers up in it.
    """
    seeds = sampled(reads, params) if seeds is None else seeds
    recount = seeds.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    counted = table.select("kmer", "info").join(recount, "kmer", "left")
    found = F.coalesce("n", F.lit(0))
    counted = stored(counted.select("kmer", K.saturated(found).alias("depth"), "info", found.alias("n_hits"), found.alias("_weight")), "read-kmers")
    lengths = reads.select("read_id", F.length(bases(F.col("seq"))).cast("bigint").alias("len"))
    placed = lookup(seeds, counted, "kmer", "read_id", weight="_weight")
    return Readset(lengths, placed, counted.drop("_weight"), params)


def with_info(readset: Readset, table: DataFrame, sparse: bool = False) -> Readset:
    """The same seeds under a reclassified k-mer ``table`` (kmer, depth, info).

    With ``sparse`` the table has only the k-mers that are asked for: seeds of all others are misses and are not shuffled.
    """
    table = stored(table.select("kmer", "depth", "info"), "read-kmers")
    bare = readset.seeds.drop("depth", "info")
    return replace(readset, seeds=lookup(bare, table, "kmer", "read_id", sparse=sparse), table=table)


def read_summary(readset: Readset) -> DataFrame:
    """Per read: length, hits, misses and hits by copy class."""
    copy = K.copy_class(F.col("info"))
    per_read = readset.seeds.groupBy("read_id").agg(
        F.count("info").alias("n_hit"),
        F.count(F.when(F.col("info").isNull(), 1)).alias("n_miss"),
        *[F.count(F.when(copy == c, 1)).alias(f"n_copy{c}") for c in range(4)],
    )
    numbers = ["n_hit", "n_miss", *[f"n_copy{c}" for c in range(4)]]
    joined = readset.reads.join(per_read, "read_id", "left")
    return joined.select("read_id", "len", *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers])


def deltas(readset: Readset) -> DataFrame:
    """Distance of each hit to the previous one of its read (first: its position)."""
    dx = F.col("pos") - F.lag("pos", 1, 0).over(_by_pos())
    order = F.row_number().over(_by_pos()) - 1
    return readset.hits.select("read_id", order.alias("ord"), "kmer", dx.alias("dx"))


def positions(delta_hits: DataFrame) -> DataFrame:
    """Absolute positions back from ``deltas``."""
    upto = W.partitionBy("read_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return delta_hits.select("read_id", "ord", "kmer", F.sum("dx").over(upto).alias("pos"))


# Read flags.
BAD_REPEAT, BAD_ORDER10, BAD_ORDER1, BAD_NO_MATCH, BAD_LOW_HIT, BAD_LOW_COPY1 = 1, 2, 4, 8, 16, 32
BAD_NAMES = {
    "repeat": BAD_REPEAT,
    "order10": BAD_ORDER10,
    "order1": BAD_ORDER1,
    "no_match": BAD_NO_MATCH,
    "low_hit": BAD_LOW_HIT,
    "low_copy1": BAD_LOW_COPY1,
}


def statistics(readset: Readset, flags: DataFrame | None = None) -> DataFrame:
    """Readset totals as (metric, value) rows; ratios with an empty denominator are NULL.

    ``flags`` has ``read_id`` and the bit mask ``bad``.
    """
    reads = read_summary(readset)
    reads = reads.join(flags.select("read_id", "bad"), "read_id", "left") if flags is not None else reads.withColumn("bad", F.lit(0))
    bad = F.coalesce("bad", F.lit(0))
    lone = F.col("n_copy1")
    groups = {"0": lone == 0, "1": lone == 1, "more": lone > 1}
    sums = {
        "n_reads": F.count(F.lit(1)),
        "total_len": F.sum("len"),
        "n_hit": F.sum("n_hit"),
        "n_miss": F.sum("n_miss"),
        "bad": F.count(F.when(bad != 0, 1)),
        **{f"n_copy{c}": F.sum(f"n_copy{c}") for c in range(4)},
        **{f"reads_copy1_{g}": F.count(F.when(cond, 1)) for g, cond in groups.items()},
        **{f"len_copy1_{g}": F.coalesce(F.sum(F.when(cond, F.col("len"))), F.lit(0)) for g, cond in groups.items()},
        **{f"bad_{name}": F.count(F.when(bad.bitwiseAND(F.lit(bit)) != 0, 1)) for name, bit in BAD_NAMES.items()},
    }
    copy, depth = K.copy_class(F.col("info")), F.col("depth")
    for c in range(4):
        mine = copy == c
        sums[f"kmers_copy{c}"] = F.count(F.when(mine, 1))
        sums[f"kmers_hit_copy{c}"] = F.count(F.when(mine & (depth > 0), 1))
        sums[f"kmers_multi_copy{c}"] = F.count(F.when(mine & (depth > 1), 1))
        sums[f"depth_multi_copy{c}"] = F.coalesce(F.sum(F.when(mine & (depth > 1), depth)), F.lit(0))
    on_table = [n for n in sums if n.startswith(("kmers_", "depth_"))]
    on_reads = [n for n in sums if n not in on_table]

    def ratios(names: set[str]) -> dict[str, tuple]:
        c = F.col
        every = {
            "mean_len": (c("total_len"), c("n_reads")),
            "bp_per_hit": (c("total_len"), c("n_hit")),
            "hit_fraction": (c("n_hit"), c("n_hit") + c("n_miss")),
            "hits_per_read": (c("n_hit"), c("n_reads")),
            **{f"fraction_copy{i}": (c(f"n_copy{i}"), c("n_hit")) for i in range(4)},
            **{f"mean_len_copy1_{g}": (c(f"len_copy1_{g}"), c(f"reads_copy1_{g}")) for g in groups},
            "mean_copy1_more": (c("n_copy1") - c("reads_copy1_1"), c("reads_copy1_more")),
        }
        on_kmers = {
            **{f"kmer_hit_fraction_copy{i}": (c(f"kmers_hit_copy{i}"), c(f"kmers_copy{i}")) for i in range(4)},
            **{f"kmer_multi_fraction_copy{i}": (c(f"kmers_multi_copy{i}"), c(f"kmers_copy{i}")) for i in range(4)},
            **{f"kmer_mean_depth_copy{i}": (c(f"depth_multi_copy{i}"), c(f"kmers_multi_copy{i}")) for i in range(4)},
        }
        return every if "n_reads" in names else on_kmers

    def long_form(frame: DataFrame, names: list[str]) -> DataFrame:
        one = frame.agg(*[sums[n].alias(n) for n in names])
        pairs = [(n, F.col(n).cast("double")) for n in names]
        pairs += [(n, F.try_divide(a.cast("double"), b.cast("double"))) for n, (a, b) in ratios(set(names)).items()]
        return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in pairs])))

    return long_form(reads, on_reads).unionByName(long_form(readset.table, on_table))


def kmer_flags(readset: Readset) -> DataFrame:
    """Flags seen in any read: repeat, internal and minor, per k-mer of the table that has one.

    Repeat: twice in a read. Internal: both neighbours nearer than w, not at an
    end. Minor: less than half the depth of an adjacent hit.
    """
    within = W.partitionBy("read_id", "kmer")
    before, after = F.lag("pos").over(_by_pos()), F.lead("pos").over(_by_pos())
    near = (F.col("pos") - before < readset.params.w) & (after - F.col("pos") < readset.params.w)
    deeper = F.greatest(
        F.coalesce(F.lag("depth").over(_by_pos()), F.lit(0)), F.coalesce(F.lead("depth").over(_by_pos()), F.lit(0))
    )
    marked = readset.hits.select(
        "kmer",
        (F.count(F.lit(1)).over(within) > 1).alias("is_repeat"),
        F.coalesce(near, F.lit(False)).alias("is_internal"),
        (deeper > 2 * F.col("depth")).alias("is_minor"),
    )
    flagged = marked.where("is_repeat or is_internal or is_minor")
    return flagged.groupBy("kmer").agg(*[F.bool_or(c).alias(c) for c in ("is_repeat", "is_internal", "is_minor")])


def apply_flags(table: DataFrame, flags: DataFrame) -> DataFrame:
    """Set the info bits found by ``kmer_flags``; bits are never cleared."""
    joined = table.join(flags, "kmer", "left")
    info = F.col("info")
    for column, bit in (("is_repeat", K.REPEAT), ("is_internal", K.INTERNAL), ("is_minor", K.MINOR)):
        info = K.with_flag(info, bit, F.coalesce(column, F.lit(False)))
    return joined.select("kmer", "depth", info.alias("info"))


def _strand_counts(readset: Readset) -> DataFrame:
    single = readset.hits.where(K.copy_class(F.col("info")) == 1)
    return single.groupBy("read_id", "kmer").agg(
        F.count(F.when(F.col("is_fwd"), 1)).alias("f"), F.count(F.when(~F.col("is_fwd"), 1)).alias("r")
    )


def read_properties(readset: Readset) -> DataFrame:
    """Per read: distinct single-copy k-mers and how they repeat on the two strands."""
    f, r = F.col("f"), F.col("r")
    total = f + r
    kind = (
        F.when(total == 1, "once")
        .when((f == 1) & (r == 1), "two_reversed")
        .when((total == 2), "two_tandem")
        .when((f > 0) & (r > 0), "more_reversed")
        .otherwise("more_tandem")
    )
    classed = _strand_counts(readset).withColumn("kind", kind)
    names = ("two_tandem", "two_reversed", "more_tandem", "more_reversed")
    counts = classed.groupBy("read_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in names]
    )
    joined = readset.reads.join(counts, "read_id", "left")
    return joined.select("read_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", *names)])


def repeated_kmers(readset: Readset, min_tandem: int = 5) -> DataFrame:
    """The k-mers seen over twice in reads with more than ``min_tandem`` tandem ones."""
    counts = _strand_counts(readset).withColumn("total", F.col("f") + F.col("r"))
    tandem = (F.col("total") > 2) & ((F.col("f") == 0) | (F.col("r") == 0))
    n_tandem = F.sum(tandem.cast("int")).over(W.partitionBy("read_id"))
    kept = counts.withColumn("n_tandem", n_tandem).where((F.col("n_tandem") > min_tandem) & (F.col("total") > 2))
    return kept.select("read_id", "kmer", "total")
