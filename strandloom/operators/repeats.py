"""Reads over one repeat unit: strand vote, k-mer cleaning and identical read blocks.

``hits`` have read_id, kmer and ``x`` (position on the reference's strand);
``mods`` have kmer and ``n``, the count each step of the analysis goes by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.functions import kernel
from strandloom.functions.sequences import bases
from strandloom.operators.sketch import sampled_kmers
from strandloom.params import SketchParams
from strandloom.session import HOT_KEYS, checkpointed, lookup, maybe_member, stored

MIN_SUPPORT = 5  # fewest hits of a k-mer or of a link between neighbours


def reference_kmers(refs: DataFrame, params: SketchParams, strict: bool = False) -> DataFrame:
    """k-mers occurring once in the reference: kmer, pos, is_fwd. ``strict`` fails on a repeated one."""
    hits = sampled_kmers(refs, params, emit=("kmer", "is_fwd", "pos"))
    grouped = hits.groupBy("kmer").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("read_id", "pos", "is_fwd")).alias("at")
    )
    if strict:
        message = F.concat(F.lit("repeated reference k-mer "), F.col("kmer"))
        once = F.when(F.col("n") > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    else:
        once = F.col("n") == 1
    return grouped.where(once).select("kmer", "at.pos", "at.is_fwd")


def _present(seeds: DataFrame, keyed: DataFrame) -> DataFrame:
    """``lookup`` of stored seeds; those that ``keyed`` surely lacks are left out before the shuffle."""
    there = maybe_member(seeds, keyed.select("kmer"), ["kmer"]).where("_maybe").drop("_maybe")
    return lookup(there, keyed, "kmer", "read_id")


def strand_vote(
    reads: DataFrame, reference: DataFrame, params: SketchParams, first: int = 100, tolerance: int = 10
) -> DataFrame:
    """Strand of each read by its first ``first`` reference hits.

    Bad: fewer hits than that, or more than ``tolerance`` votes for both strands.
    """
    seeds = stored(sampled_kmers(reads, params, emit=("kmer", "is_fwd", "pos")), "votes")
    keyed = stored(reference.select("kmer", F.col("is_fwd").alias("ref_fwd")), "reference-strands")
    found = _present(seeds, keyed).where(F.col("ref_fwd").isNotNull())
    rank = F.row_number().over(W.partitionBy("read_id").orderBy("pos"))
    same = F.col("is_fwd") == F.col("ref_fwd")
    votes = found.withColumn("rank", rank).where(F.col("rank") <= first).groupBy("read_id").agg(
        F.count(F.when(same, 1)).alias("n_fwd"), F.count(F.when(~same, 1)).alias("n_rev")
    )
    lengths = reads.select("read_id", F.length(bases(F.col("seq"))).cast("bigint").alias("len"))
    joined = lengths.join(votes, "read_id", "left")
    fwd, rev = F.coalesce("n_fwd", F.lit(0)), F.coalesce("n_rev", F.lit(0))
    bad = (fwd + rev < first) | ((fwd > tolerance) & (rev > tolerance))
    return joined.select(
        "read_id", "len", fwd.alias("n_fwd"), rev.alias("n_rev"), bad.alias("is_bad"), (fwd >= rev).alias("is_forward")
    )


def oriented_hits(reads: DataFrame, votes: DataFrame, table: DataFrame, params: SketchParams) -> DataFrame:
    """Hits of good reads to the k-mer table, positions counted on the reference's strand.

    Turning a read around keeps its canonical k-mers, so positions are mirrored
    instead of scanning the turned text.
    """
    seeds = stored(sampled_kmers(reads, params, emit=("kmer", "pos", "len")), "oriented")
    keyed = stored(table.select("kmer", "depth"), "depths")
    found = _present(seeds, keyed).where(F.col("depth").isNotNull())
    good = votes.where(~F.col("is_bad")).select("read_id", "is_forward")
    mirrored = (F.col("len") - params.k - F.col("pos")).cast("int")
    return found.join(good, "read_id").select(
        "read_id", "kmer", F.when(F.col("is_forward"), F.col("pos")).otherwise(mirrored).alias("x")
    )


def count_mods(hits: DataFrame) -> DataFrame:
    return hits.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def usable_mods(mods: DataFrame, n_reads: int) -> DataFrame:
    """k-mers seen at least MIN_SUPPORT times and at most half as often as there are reads."""
    return mods.where((F.col("n") >= MIN_SUPPORT) & (F.col("n") <= n_reads // 2))


def keep_mods(hits: DataFrame, mods: DataFrame) -> DataFrame:
    found = lookup(hits, mods.select("kmer", "n"), "kmer", "read_id", weight="n")
    return found.where(F.col("n").isNotNull()).select("read_id", "kmer", "x")


def thin_hits(hits: DataFrame, gap: int) -> DataFrame:
    """Greedily keep hits at least ``gap`` after the last kept one of their read.

    Partitions are sorted by read and position and streamed with two values of
    state, so memory does not depend on the length of a read; the chain of kept
    rows of a batch is found by pointer doubling.
    """
    ordered = hits.repartition("read_id").sortWithinPartitions("read_id", "x")
    return ordered.mapInArrow(kernel.spaced_rows(gap), hits.schema)


def neighbours(hits: DataFrame) -> DataFrame:
    """Consecutive hits of each read: read_id, k0, k1, dx."""
    by_x = W.partitionBy("read_id").orderBy("x")
    paired = hits.select(
        "read_id", F.lag("kmer").over(by_x).alias("k0"), F.col("kmer").alias("k1"), (F.col("x") - F.lag("x").over(by_x)).alias("dx")
    )
    return paired.where(F.col("k0").isNotNull())


def adjacency(hits: DataFrame) -> DataFrame:
    """Support and total distance of each ordered pair of neighbouring k-mers."""
    return neighbours(hits).groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("n"), F.sum("dx").alias("sum_dx"))


def commonest_neighbour(links: DataFrame) -> DataFrame:
    """Per k-mer and side: number of links and the neighbour with most (ties: least k-mer)."""
    sides = F.array(
        F.struct(F.col("k0").alias("kmer"), F.lit("post").alias("side"), F.col("k1").alias("other")),
        F.struct(F.col("k1").alias("kmer"), F.lit("pre").alias("side"), F.col("k0").alias("other")),
    )
    rows = links.select("n", "sum_dx", F.inline(sides))
    best = F.max(F.struct("n", (-F.col("other")).alias("minus"), "sum_dx")).alias("best")
    grouped = rows.groupBy("kmer", "side").agg(F.sum("n").alias("n_links"), F.count(F.lit(1)).alias("n_neighbours"), best)
    return grouped.select(
        "kmer", "side", "n_links", "n_neighbours", (-F.col("best.minus")).alias("other"), F.col("best.n").alias("n"),
        F.floor(F.col("best.sum_dx") / F.col("best.n")).cast("bigint").alias("mean_dx"),
    )


def informative_mods(mods: DataFrame, links: DataFrame) -> DataFrame:
    """Drop k-mers that add nothing to their only predecessor, and those no neighbour supports.

    A neighbour supports when its link is seen MIN_SUPPORT times and makes up
    more than half of the k-mer's count or of the neighbour's links on that side.
    """
    # A k-mer between varying neighbours has as many links as there are of them: all three joins are safe for such hubs.
    links = stored(links.select("k0", "k1", "n"), "links")
    degree = F.count(F.lit(1)).alias("_weight")
    post = lookup(links, links.groupBy("k0").agg(F.sum("n").alias("other"), degree), "k0", "k1", weight="_weight")
    pre = lookup(links, links.groupBy("k1").agg(F.sum("n").alias("other"), degree), "k1", "k0", weight="_weight")
    into = post.select(F.col("k1").alias("kmer"), F.col("k0").alias("beside"), F.col("n").alias("link"), "other", F.lit(True).alias("is_pre"))
    out = pre.select(F.col("k0").alias("kmer"), F.col("k1").alias("beside"), F.col("n").alias("link"), "other", F.lit(False).alias("is_pre"))
    judged = lookup(into.unionByName(out), mods.select("kmer", "n"), "kmer", "beside").where(F.col("n").isNotNull())
    half = F.floor(F.col("n") / 2)
    supports = (F.col("link") >= MIN_SUPPORT) & ((F.col("link") > half) | (F.col("link") > F.floor(F.col("other") / 2)))
    redundant = F.col("is_pre") & (F.col("link") == F.col("n")) & (F.col("link") == F.col("other"))
    verdict = judged.groupBy("kmer").agg(F.bool_or(supports).alias("supported"), F.bool_or(redundant).alias("redundant"))
    kept = verdict.where(F.col("supported") & ~F.col("redundant")).select("kmer")
    return mods.join(kept, "kmer", "left_semi")


def weak_reads(hits: DataFrame) -> DataFrame:
    """Reads with a neighbouring pair seen fewer than MIN_SUPPORT times.

    The HOT_KEYS commonest pairs have support, so their rows leave map-side; any other
    pair holds less than 1/HOT_KEYS of the rows that are shuffled.
    """
    pairs = neighbours(hits)
    seen = stored(pairs.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("n")), "pairs")
    common = seen.where(F.col("n") >= MIN_SUPPORT).orderBy(F.desc("n"), "k0", "k1").limit(HOT_KEYS)
    rare = pairs.join(F.broadcast(common), ["k0", "k1"], "left_anti")
    return rare.join(seen.where(F.col("n") < MIN_SUPPORT), ["k0", "k1"], "left_semi").select("read_id").distinct()


def count_without_last(hits: DataFrame) -> DataFrame:
    """Counts that leave out the last hit of each read."""
    following = F.lead("x").over(W.partitionBy("read_id").orderBy("x"))
    return count_mods(hits.withColumn("following", following).where("following is not null"))


def analyse(reads: DataFrame, votes: DataFrame, table: DataFrame, params: SketchParams) -> dict[str, DataFrame]:
    """Clean, thin, drop uninformative k-mers and weakly linked reads, twice over.

    Returns the surviving ``reads``, ``hits``, ``mods`` and ``links``; each stage
    is checkpointed, as later ones read it several times.
    """
    good = checkpointed(votes.where(~F.col("is_bad")).select("read_id"))
    n_reads = good.count()
    hits = checkpointed(oriented_hits(reads, votes, table, params))
    hits = keep_mods(hits, usable_mods(count_mods(hits), n_reads))
    hits = checkpointed(thin_hits(hits, params.k))
    mods = usable_mods(count_mods(hits), n_reads)
    hits = checkpointed(keep_mods(hits, mods))

    mods = checkpointed(informative_mods(count_mods(hits), adjacency(hits)))
    hits = checkpointed(keep_mods(hits, mods))

    weak = checkpointed(weak_reads(hits))
    good = checkpointed(good.join(weak, "read_id", "left_anti"))
    hits = hits.join(weak, "read_id", "left_anti")
    mods = checkpointed(usable_mods(count_without_last(hits), good.count()))
    hits = checkpointed(keep_mods(hits, mods))

    mods = checkpointed(informative_mods(mods, adjacency(hits)))
    hits = checkpointed(keep_mods(hits, mods))
    return {"reads": good, "hits": hits, "mods": mods, "links": adjacency(hits)}


def read_blocks(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """Groups of reads with the same k-mer list: the list, its length and the reads in it.

    A list is bounded by its read; the grouping itself counts, it collects nothing.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("x", "kmer"))), lambda h: h["kmer"])
    lists = hits.groupBy("read_id").agg(ordered.alias("kmers"))
    full = reads.join(lists, "read_id", "left")
    listed = full.select("read_id", F.coalesce("kmers", F.array().cast("array<bigint>")).alias("kmers"))
    return listed.groupBy("kmers").agg(F.count(F.lit(1)).alias("n_reads"), F.min("read_id").alias("first_read")).withColumn(
        "n_mods", F.size("kmers")
    )


def duplicate_summary(votes: DataFrame, hits: DataFrame, table: DataFrame) -> DataFrame:
    """Reads used, k-mers repeated within a read, and the least depth that covers every read.

    k-mers repeated in any read are left out; the last figure is the minimum over
    reads of the deepest remaining k-mer. Rows of (metric, value).
    """
    per_read = hits.groupBy("kmer", "read_id").agg(F.count(F.lit(1)).alias("n"))
    per_kmer = per_read.groupBy("kmer").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("n_dup"))
    single = per_kmer.where("n_dup = 0").select("kmer", "n")
    deepest = lookup(hits.select("read_id", "kmer"), single, "kmer", "read_id", weight="n").groupBy("read_id").agg(F.max("n").alias("deep"))

    def metrics(frame: DataFrame, **values) -> DataFrame:
        one = frame.agg(*[v.cast("double").alias(n) for n, v in values.items()])
        return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in values])))

    bad = F.count(F.when(F.col("is_bad"), 1))
    dup = F.count(F.when(F.col("n_dup") > 0, 1))
    return (
        metrics(votes, n_reads=F.count(F.lit(1)), n_bad=bad, n_good=F.count(F.lit(1)) - bad)
        .unionByName(metrics(table, n_mods=F.count(F.lit(1))))
        .unionByName(metrics(per_kmer, n_dup=dup, mean_dup=F.try_divide(F.sum("n_dup"), dup)))
        .unionByName(metrics(deepest, min_max=F.min("deep")))
    )


def boundary_cooccurrence(reads: DataFrame, boundaries: list[int], params: SketchParams) -> DataFrame:
    """Reads holding each boundary k-mer together with the next one around the ring."""
    hits = sampled_kmers(reads, params, emit=("kmer",)).where(F.col("kmer").isin(*boundaries))
    held = hits.groupBy("read_id").agg(
        *[F.bool_or(F.col("kmer") == b).alias(f"b{i}") for i, b in enumerate(boundaries)]
    )
    n = len(boundaries)
    return held.agg(*[F.count(F.when(F.col(f"b{i}") & F.col(f"b{(i + 1) % n}"), 1)).alias(f"n{i + 1}") for i in range(n)])
