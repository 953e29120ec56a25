"""Reference index, query lookup and chaining of seeds into mapped blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.functions import chain
from strandloom.functions.sequences import bases, ratio
from strandloom.operators.sketch import sampled_kmers
from strandloom.params import SketchParams
from strandloom.session import lookup, stored, with_ordinal

MAX_GAP_DRIFT = 50  # allowed difference of reference and seed spans within a block
MIN_BLOCK_SEEDS = 2  # a block is reported with more single-copy seeds than this


def index_reference(refs: DataFrame, params: SketchParams) -> DataFrame:
    """Every sampled occurrence: ``loc`` (0, 1, ... in reference order), kmer, ref_id, offset, is_fwd."""
    hits = sampled_kmers(refs, params, emit=("kmer", "is_fwd", "pos"))
    numbered = with_ordinal(hits, ["read_id", "pos"], "loc")
    return numbered.select("loc", "kmer", F.col("read_id").alias("ref_id"), F.col("pos").alias("offset"), "is_fwd")


def reference_kmers(index: DataFrame) -> DataFrame:
    """Per k-mer: occurrences, copy class (1, 2, 3 for more) and first and second place.

    A k-mer that occurs twice has its second place as the greatest, so counting
    and two extremes are enough: nothing is collected per k-mer.
    """
    place = F.struct("loc", "ref_id", "offset")
    grouped = index.groupBy("kmer").agg(
        F.count(F.lit(1)).alias("depth"), F.min(place).alias("first"), F.max(place).alias("last")
    )
    copy = F.when(F.col("depth") == 1, 1).when(F.col("depth") == 2, 2).otherwise(3)
    return grouped.select("kmer", "depth", copy.alias("copy"), "first", F.when(copy == 2, F.col("last")).alias("second"))


def copy_class_counts(ref_kmers: DataFrame) -> DataFrame:
    return ref_kmers.groupBy("copy").agg(F.count(F.lit(1)).alias("n_kmers"), F.sum("depth").alias("n_hits"))


def query_seeds(queries: DataFrame, ref_kmers: DataFrame, params: SketchParams, kept: bool = False) -> DataFrame:
    """All sampled k-mers of each query with copy class and places (NULL when missing).

    Queries are sampled once; only k-mers that the reference may have are shuffled. ``kept``: ``ref_kmers``
    is a stored table already and is read as it is; bucketed by k-mer, it is not shuffled.
    """
    hits = stored(sampled_kmers(queries, params, emit=("ord", "kmer", "is_fwd", "pos")), "query-seeds")
    return lookup(hits, ref_kmers if kept else stored(ref_kmers, "reference-kmers"), "kmer", "read_id", sparse=True)


def query_summary(queries: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per query: length, missed seeds, seeds per copy class and fraction found.

    Queries without seeds enter as zero rows, which saves a join; their fraction
    is NULL.
    """
    zero = F.lit(0).cast("bigint")
    base = queries.select("read_id", F.length(bases(F.col("seq"))).cast("bigint").alias("len"), zero.alias("seeds"), F.lit(None).cast("int").alias("copy"))
    rows = base.unionByName(seeds.select("read_id", zero.alias("len"), F.lit(1).cast("bigint").alias("seeds"), "copy"))
    found = {c: F.count(F.when(F.col("copy") == c, 1)) for c in (1, 2, 3)}
    totals = rows.groupBy("read_id").agg(
        F.sum("len").alias("len"), F.sum("seeds").alias("n_seed"), F.count("copy").alias("n_found"),
        found[1].alias("n_copy1"), found[2].alias("n_copy2"), found[3].alias("n_multi"),
    )
    return totals.select(
        "read_id", "len", (F.col("n_seed") - F.col("n_found")).alias("n_miss"), "n_copy1", "n_copy2", "n_multi",
        ratio(F.col("n_found"), F.col("n_seed")).alias("hit_fraction"),
    )


def seed_places(seeds: DataFrame) -> DataFrame:
    """One row per seed and reference place, for seeds with one or two places."""
    places = F.filter(F.array("first", "second"), lambda place: place.isNotNull())
    usable = seeds.where(F.col("copy") < 3)
    exploded = usable.select("read_id", "ord", "pos", "kmer", "copy", F.posexplode(places).alias("place", "at"))
    return exploded.select("read_id", "ord", "pos", "kmer", "copy", "place", "at.ref_id", "at.offset", "at.loc")


def paint(refs: DataFrame, table: DataFrame, params: SketchParams) -> DataFrame:
    """Depth in a k-mer table along each sequence."""
    hits = stored(sampled_kmers(refs, params, emit=("kmer", "pos")), "painted")
    found = lookup(hits, stored(table.select("kmer", "depth"), "depths"), "kmer", "read_id", sparse=True)
    return found.where(F.col("depth").isNotNull()).select("read_id", "pos", "depth")


def chain_blocks(seeds: DataFrame, strict: bool = False) -> DataFrame:
    """Fold each query's seeds, in position order, into collinear reference blocks.

    Reference place 0 also means "no block yet". A two-copy seed that would end a
    block is tried at its second place. The last block is reported by its
    single-copy seeds like the others; ``strict`` uses its two-copy seeds instead.
    Seeds are sorted by query and streamed past one open block, so a query with very
    many seeds needs no more memory than any other.
    """
    place = {f"{which}_{c}": F.col(which)[c] for which in ("first", "second") for c in chain.PLACE}
    usable = seeds.where(F.col("copy") < 3).select(
        "read_id", "ord", "pos", (F.col("copy") == 1).alias("single"), *[c.alias(name) for name, c in place.items()]
    )
    ordered = usable.repartition("read_id").sortWithinPartitions("read_id", "ord", "pos")
    id_field = ordered.schema["read_id"]
    folding = chain.blocks(MIN_BLOCK_SEEDS, MAX_GAP_DRIFT, strict)
    folded = ordered.mapInArrow(folding, f"read_id {id_field.dataType.simpleString()}, {chain.SCHEMA}")
    n_single = F.max("n_single").over(W.partitionBy("read_id"))
    rows = folded.withColumn("n_single", n_single).where(F.col("q0").isNotNull())
    return rows.select(
        "read_id",
        F.col("q0").alias("query_start"),
        F.col("qN").alias("query_end"),
        (F.col("qN") - F.col("q0")).alias("span"),
        F.col("start_ref").alias("ref_id"),
        F.col("start_offset").alias("ref_start"),
        F.col("end_offset").alias("ref_end"),
        "n1",
        "n2",
        ratio(F.col("n1") + F.col("n2"), F.abs(F.col("end_loc") - F.col("start_loc"))).alias("density"),
        ratio(F.col("n1"), F.col("n_single")).alias("single_fraction"),
    )
