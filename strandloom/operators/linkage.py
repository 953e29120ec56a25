"""k-mers placed against a repeat reference, and tests of their linkage in reads.

``marks`` has one row per k-mer of the readset's table: kmer, depth, info (with
the MARKED bit), in_ref, kind (core, multi, var; NULL when unmarked), ref_pos.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.functions import kmers as K
from strandloom.functions import pairing
from strandloom.operators.readset import Readset
from strandloom.operators.sketch import sampled_kmers
from strandloom.session import discard, gathered, lookup, passing_shuffles, stored

CORE_DEPTH, MULTI_DEPTH = 2750, 4750  # defaults for the repeat the tool was made for
TILE = 4096  # positions of a home read whose anchors share a cell
CELL_HITS = 1 << 21  # hits of the reads in a cell of anchors
ROUND_HITS, ROUND_SHARE = 1 << 24, 2  # hits shuffled to cells in one round: as many, or so many times the eligible ones if that is more
DOUBLINGS = 24  # of the number of cells
NEAR = 50  # inferred positions must agree within this


def _kind(depth: Column, core: int, multi: int) -> Column:
    return F.when(depth > multi, "multi").when(depth > core, "core").otherwise("var")


def mark_reference(readset: Readset, refs: DataFrame, core: int = CORE_DEPTH, multi: int = MULTI_DEPTH) -> DataFrame:
    """Mark the table's k-mers that occur in ``refs``; the last occurrence gives the position."""
    hits = sampled_kmers(refs, readset.params, emit=("kmer", "pos"))
    placed = hits.groupBy("kmer").agg(F.max(F.struct("read_id", "pos")).alias("last"))
    joined = readset.table.join(placed, "kmer", "left")
    in_ref = F.col("last").isNotNull()
    return joined.select(
        "kmer",
        "depth",
        K.with_flag(F.col("info"), K.MARKED, in_ref).alias("info"),
        in_ref.alias("in_ref"),
        F.when(in_ref, _kind(F.col("depth"), core, multi)).alias("kind"),
        F.col("last.pos").alias("ref_pos"),
    )


def _marked_hits(readset: Readset, marks: DataFrame) -> DataFrame:
    """Hits with the place of their k-mer in the reference; those of other k-mers are not shuffled."""
    bare = readset.hits.select("read_id", "kmer", "pos")
    keyed = stored(marks.where("in_ref").select("kmer", "in_ref", "kind", "ref_pos"), "reference-kmers")
    return lookup(bare, keyed, "kmer", "read_id", sparse=True).withColumn("in_ref", F.coalesce("in_ref", F.lit(False)))


def covered_hits(readset: Readset, marks: DataFrame, n: int = 200) -> DataFrame:
    """Hits of each read from its n-th core reference hit from the left to just before the
    n-th from the right, with the last reference position so far.

    Reads without such a stretch are not repeat reads and give no rows.
    """
    by_pos = W.partitionBy("read_id").orderBy("pos")
    whole = W.partitionBy("read_id")
    anchor = F.coalesce(F.col("in_ref") & (F.col("kind") == "core"), F.lit(False))
    counted = _marked_hits(readset, marks).withColumn("anchor", anchor)
    counted = counted.withColumn("from_left", F.sum(anchor.cast("int")).over(by_pos.rowsBetween(W.unboundedPreceding, 0)))
    counted = counted.withColumn("anchors", F.sum(anchor.cast("int")).over(whole))
    nth_left = F.min(F.when(anchor & (F.col("from_left") == n), F.col("pos"))).over(whole)
    nth_right = F.min(F.when(anchor & (F.col("anchors") - F.col("from_left") + 1 == n), F.col("pos"))).over(whole)
    bounded = counted.withColumn("left_at", nth_left).withColumn("right_at", nth_right)
    inside = bounded.where((F.col("pos") >= F.col("left_at")) & (F.col("pos") < F.col("right_at")))
    seen = F.last(F.when(F.col("in_ref"), F.col("ref_pos")), ignorenulls=True)
    carried = F.coalesce(seen.over(by_pos.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    return inside.select("read_id", "kmer", "pos", "in_ref", carried.alias("last_ref_pos"))


def repeat_reads(covered: DataFrame) -> DataFrame:
    return covered.select("read_id").distinct()


def infer_positions(
    marks: DataFrame, covered: DataFrame, core: int = CORE_DEPTH, multi: int = MULTI_DEPTH
) -> DataFrame:
    """Mark the other k-mers of covered stretches and give them a position.

    A single observation is taken as is; several give their mean (rounded down),
    or -1 when it is 0 or an observation is NEAR or more away. This does not
    depend on the order of the reads, and is combined map-side, so a k-mer
    holding much of the table is no bottleneck.
    """
    seen = covered.where(~F.col("in_ref")).groupBy("kmer").agg(
        F.count(F.lit(1)).alias("n_seen"), F.sum("last_ref_pos").alias("total"),
        F.min("last_ref_pos").alias("low"), F.max("last_ref_pos").alias("high"),
    )
    mean = F.floor(F.col("total") / F.col("n_seen")).cast("int")
    agrees = (mean > 0) & (F.col("high") - mean < NEAR) & (mean - F.col("low") < NEAR)
    position = F.when(F.col("n_seen") == 1, F.col("low")).when(agrees, mean).otherwise(-1)
    joined = marks.join(seen.select("kmer", position.alias("inferred")), "kmer", "left")
    new = F.col("inferred").isNotNull()
    return joined.select(
        "kmer",
        "depth",
        K.with_flag(F.col("info"), K.MARKED, new).alias("info"),
        "in_ref",
        F.when(new, _kind(F.col("depth"), core, multi)).otherwise(F.col("kind")).alias("kind"),
        F.coalesce("inferred", "ref_pos").alias("ref_pos"),
    )


def hit_text(readset: Readset, marks: DataFrame) -> DataFrame:
    """Each hit in words: k-mer, strand, depth, copy class, position (P in the reference, p inferred)."""
    placed = marks.select("kmer", "depth", F.col("info").alias("mark_info"), "in_ref", "ref_pos")
    hits = lookup(readset.hits.select("read_id", "pos", "kmer", "is_fwd"), placed, "kmer", "read_id")
    text = F.format_string(
        "%d %s d %d C%d %s %d",
        "kmer",
        F.when(F.col("is_fwd"), "F").otherwise("R"),
        "depth",
        K.copy_class(F.col("mark_info")),
        F.when(F.col("in_ref"), "P").otherwise("p"),
        F.coalesce("ref_pos", F.lit(0)),
    )
    return hits.select("read_id", "pos", text.alias("text"))


def mark_summary(marks: DataFrame) -> DataFrame:
    """Counts of marked k-mers by reference membership, kind and copy class."""
    copied = K.copy_class(F.col("info")) > 0
    marked = marks.where(F.col("kind").isNotNull())
    classed = marked.select(
        "in_ref",
        F.when(F.col("kind") != "var", F.col("kind")).when(copied, "var_copied").otherwise("var_copy0").alias("class"),
        (F.col("ref_pos") > 0).alias("placed"),
    )
    return classed.groupBy("in_ref", "class").agg(
        F.count(F.lit(1)).alias("n_kmers"), F.count(F.when(F.col("placed"), 1)).alias("n_placed")
    )


def reset_core(marks: DataFrame, skip_repeats: bool = False) -> DataFrame:
    """Core k-mers (optionally only those never repeated in a read) to copy 1, all others to 0."""
    core = F.coalesce(F.col("kind") == "core", F.lit(False))
    if skip_repeats:
        core = core & ~K.has_flag(F.col("info"), K.REPEAT)
    return marks.withColumn("info", K.with_copy(F.col("info"), F.when(core, 1).otherwise(0)))


def reset_core_by_read(marks: DataFrame, readset: Readset, read: int) -> DataFrame:
    """Core k-mers not repeated in one given read to copy 1, all others to 0."""
    repeated = readset.hits.where(F.col("read_id") == read).groupBy("kmer").agg(F.count(F.lit(1)).alias("_n"))
    cored = reset_core(marks).join(repeated.where("_n > 1"), "kmer", "left")
    info = F.when(F.col("_n").isNotNull(), K.with_copy(F.col("info"), 0)).otherwise(F.col("info"))
    return cored.withColumn("info", info).drop("_n")


def eligible(info: Column) -> Column:
    return (K.copy_class(info) != 0) & K.has_flag(info, K.MARKED) & ~K.has_flag(info, K.REPEAT)


def _eligible_reads(readset: Readset) -> DataFrame:
    """Each read's eligible hits in order (arrays ``m_*``) as a stored table: hits are shuffled once and read several times."""
    hits = readset.hits.where(eligible(F.col("info")))
    reads = hits.groupBy("read_id").agg(F.max("len").alias("len"), F.array_sort(F.collect_list(F.struct("pos", "kmer", "depth", "is_fwd"))).alias("hits"))
    names = {"m_mod": "kmer", "m_pos": "pos", "m_depth": "depth", "m_is_fwd": "is_fwd"}
    return stored(reads.select("read_id", "len", *[F.col(f"hits.{field}").alias(name) for name, field in names.items()]), "eligible")


@dataclass(frozen=True)
class Dealt:
    """``reads`` (read_id, len, arrays ``m_*`` and ``dealt``: for each of the read's cells, the places ``a_at`` of its anchors among the hits)
    and the number of cells, which are taken in so many rounds."""

    reads: DataFrame
    cells: int
    rounds: int
    w: int

    def part(self, verdicts: bool, turn: int | None = None) -> DataFrame:
        """Pairs or verdicts of the anchors of one round, or of all."""
        rounds, mine = (1, F.col("dealt")) if turn is None else (self.rounds, F.filter("dealt", lambda d: d["cell"] % self.rounds == turn))
        arrays = [c for c in self.reads.columns if c.startswith("m_")]
        rows = self.reads.select("read_id", "len", *arrays, F.inline(mine))
        one_each = rows.repartitionById(-(-self.cells // rounds), F.floor(F.col("cell") / rounds).cast("int"))
        told = pairing.VERDICTS if verdicts else pairing.PAIRS
        return one_each.sortWithinPartitions("cell").mapInArrow(pairing.pairing(verdicts, self.w), told)

    def parts(self, verdicts: bool) -> Iterator[DataFrame]:
        """``part`` of one round after the other; each is to be used up, with ``passing_shuffles``, before the next."""
        return (self.part(verdicts, turn) for turn in range(self.rounds))


def _numbers(homed: DataFrame, n_hits: int, cores: int) -> tuple[int, int]:
    """Cells and rounds. Twice as many cells, as often as needed, until there is a cell per core and round and none has more than CELL_HITS
    hits; more than there are homes do not help. A read with h homes is in ``c (1 - (1 - 1/c)^h)`` of c cells, as homes are dealt by a hash."""
    per_read = homed.groupBy("read_id").agg(F.max("n").alias("n"), F.count_distinct("home").alias("h"))
    sizes = [cores << i for i in range(DOUBLINGS)]
    copied = [F.sum(F.col("n") * F.lit(float(c)) * (1 - F.pow(F.lit(1 - 1 / c), F.col("h")))) for c in sizes]
    copied = [x or 0 for x in per_read.agg(*copied).first()]
    homes = homed.agg(F.approx_count_distinct("home")).first()[0]
    most = max(ROUND_HITS, ROUND_SHARE * n_hits)
    for c, hits in zip(sizes, copied):
        rounds = max(1, -int(-hits // most))
        if c >= homes or (hits <= c * CELL_HITS and c >= cores * rounds):
            break
    # As many waves of whole cells in every round.
    each = max(1, c // rounds)
    return c, -(-c // (each // cores * cores or each))


def deal(readset: Readset, min_depth: int, max_depth: int) -> Dealt:
    """Reads and anchors for ``Dealt.parts``, which make pairs or verdicts cell by cell.

    An anchor's cell is that of its home, the read of most hits that holds it (by ``TILE`` positions), so anchors that
    share reads mostly share cells. A read's hits go once to each cell of its anchors, which are told by their places among the
    hits; the pairs, which are many times more, are never shuffled. The copies of reads grow faster than the reads do, up to one for each
    home of a read's anchors; so cells are made in rounds, and the disk holds the copies of one round. A task holds the hits of one cell.
    """
    with passing_shuffles(readset.hits.sparkSession):
        reads = _eligible_reads(readset)
        n_hits = reads.agg(F.sum(F.size("m_mod"))).first()[0] or 0
        zipped = F.posexplode(F.arrays_zip("m_mod", "m_pos", "m_depth")).alias("at", "hit")
        band = (F.col("hit.m_depth") >= min_depth) & (F.col("hit.m_depth") < max_depth)
        anchors = reads.select("read_id", F.size("m_mod").alias("n"), zipped).where(band)
        anchors = anchors.select(F.col("hit.m_mod").alias("anchor"), "read_id", "at", "n", F.col("hit.m_pos").alias("pos"))
        home = anchors.groupBy("anchor").agg(F.max(F.struct("n", (-F.col("read_id")).alias("minus"), "pos")).alias("home"))
        home = home.select("anchor", F.xxhash64("home.minus", F.floor(F.col("home.pos") / TILE)).alias("home"))
        homed = stored(anchors.select("anchor", "read_id", "at", "n").join(home, "anchor").drop("anchor"), "homes")
        cells, rounds = _numbers(homed, n_hits, reads.sparkSession.sparkContext.defaultParallelism)
        # By read alone, which both groupings and the join with the reads can use.
        placed = homed.select("read_id", F.pmod("home", F.lit(cells)).cast("int").alias("cell"), "at").repartition("read_id")
        by_cell = placed.groupBy("read_id", "cell").agg(F.collect_list("at").alias("a_at"))
        dealt = by_cell.groupBy("read_id").agg(F.collect_list(F.struct("cell", "a_at")).alias("dealt"))
        whole = stored(reads.join(dealt, "read_id"), "dealt")
        for done in (reads, homed):
            discard(done)
    return Dealt(whole, cells, rounds, readset.params.w)


def by_anchor(dealt: Dealt, verdicts: bool, report: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``report`` makes of all pairs or verdicts, as a stored table; it sees them round by round, all of an anchor in one of them."""
    with passing_shuffles(dealt.reads.sparkSession):
        return gathered((report(part) for part in dealt.parts(verdicts)), "reports")


def anchor_pairs(readset: Readset, min_depth: int, max_depth: int) -> DataFrame:
    """Offsets of eligible k-mers around the first occurrence of each anchor in each read.

    Anchors are the eligible k-mers of a depth band, so each has fewer than
    ``max_depth`` reads; offsets grow downstream on the anchor's strand. ``is_first`` marks one pair of every
    (anchor, mod), which counts an anchor's mods without grouping by them. All at once; ``by_anchor`` takes less disk.
    """
    return deal(readset, min_depth, max_depth).part(verdicts=False)


def anchor_reads(readset: Readset, min_depth: int, max_depth: int) -> DataFrame:
    """Each anchor's first occurrence per read with the reach on both sides of it."""
    band = (F.col("depth") >= min_depth) & (F.col("depth") < max_depth)
    anchors = readset.hits.where(eligible(F.col("info")) & band)
    first = anchors.groupBy("kmer", "read_id").agg(
        F.min(F.struct("pos", "is_fwd", "len")).alias("at"), F.max("depth").alias("depth")
    )
    pos, after = F.col("at.pos"), F.col("at.len") - F.col("at.pos") - readset.params.w
    return first.select(
        F.col("kmer").alias("anchor"),
        F.col("depth").alias("anchor_depth"),
        "read_id",
        pos.alias("pos"),
        F.col("at.is_fwd").alias("is_fwd"),
        F.when(F.col("at.is_fwd"), pos).otherwise(after).alias("upstream"),
        F.when(F.col("at.is_fwd"), after).otherwise(pos).alias("downstream"),
    )


def reach_counts(anchors: DataFrame) -> DataFrame:
    """Per anchor and side: reads reaching at least each occurring distance."""
    sides = F.array(
        F.struct(F.lit("up").alias("side"), F.col("upstream").alias("dist")),
        F.struct(F.lit("down").alias("side"), F.col("downstream").alias("dist")),
    )
    at = anchors.select("anchor", F.inline(sides)).groupBy("anchor", "side", "dist").agg(F.count(F.lit(1)).alias("n"))
    beyond = W.partitionBy("anchor", "side").orderBy(F.desc("dist")).rowsBetween(W.unboundedPreceding, 0)
    return at.select("anchor", "side", "dist", F.sum("n").over(beyond).alias("n_reads"))


def test_pairs(readset: Readset, min_depth: int, max_depth: int) -> DataFrame:
    """One verdict per (anchor, other k-mer): count, reads that reach it, good, poor, split. All at once; ``by_anchor`` takes less disk."""
    return deal(readset, min_depth, max_depth).part(verdicts=True)


COUNTS = ("n_good", "n_poor", "n_split", "n_bad_link", "n_split_link")


def _tallies(verdicts: DataFrame, run: int) -> DataFrame:
    one, zero = F.lit(1), F.lit(0)

    def tally(key: str, **values: Column) -> Column:
        return F.struct(F.col(key).alias("kmer"), *[values.get(n, zero).cast("int").alias(n) for n in COUNTS])

    down, single, poor = F.col("is_down"), F.col("is_single"), F.col("is_poor")
    as_anchor = tally(
        "anchor", n_good=F.col("is_good"), n_poor=poor, n_split=F.col("is_split"), n_bad_link=down & single
    )
    own = F.when(~down & single & ~poor, one).otherwise(zero) + (F.when(poor, one).otherwise(zero) if run > 3 else zero)
    as_partner = tally("mod", n_bad_link=own, n_split_link=F.col("is_split"))
    # Both rows of a verdict from one pass over them.
    return verdicts.select(F.inline(F.array(as_anchor, as_partner)))


def _summed(tallies: DataFrame) -> DataFrame:
    return tallies.groupBy("kmer").agg(*[F.sum(c).alias(c) for c in COUNTS])


def linkage_counts(verdicts: DataFrame, run: int = 1) -> DataFrame:
    """Per k-mer: good, poor and split partners as anchor, bad linkage and splits as partner.

    A lone downstream partner counts against the anchor, a lone upstream one
    against itself; from run 4 on poor partners count against themselves too.
    """
    return _summed(_tallies(verdicts, run))


def counts_of_rounds(dealt: Dealt, run: int = 1) -> DataFrame:
    """``linkage_counts`` of all verdicts as a stored table, summed from round to round; only the latest sums are kept."""
    total = None
    with passing_shuffles(dealt.reads.sparkSession):
        for verdicts in dealt.parts(verdicts=True):
            before, tallies = total, _tallies(verdicts, run)
            total = stored(_summed(tallies if before is None else tallies.unionByName(before)), "counts")
            if before is not None:
                discard(before)
    return total


def zero_unlinked(table: DataFrame, counts: DataFrame, run: int = 1) -> DataFrame:
    """Set copy 0 for k-mers failing the linkage rules; later runs add stricter ones."""
    good, poor, split = F.col("n_good"), F.col("n_poor"), F.col("n_split")
    bad_link, split_link = F.col("n_bad_link"), F.col("n_split_link")
    rule = (good < poor) | (split > 10)
    stage = (run - 1) % 4 + 1 if run <= 8 else 1
    if stage == 2:
        rule = rule | (bad_link > 20) | (split_link > 10)
    elif stage == 3:
        rule = rule | (poor > 25) | (split > 0) | (bad_link > 10)
    elif stage == 4:
        rule = rule | (bad_link > 6) | (split > 0)
    failing = counts.where(rule).select("kmer", F.lit(True).alias("_zero"))
    joined = table.join(failing, "kmer", "left")
    info = F.when(F.col("_zero"), K.with_copy(F.col("info"), 0)).otherwise(F.col("info"))
    return joined.withColumn("info", info).drop("_zero")
