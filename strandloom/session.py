"""Cluster-safe building blocks shared by every operator.

* ``checkpointed`` cuts lineage in the shared checkpoint folder.
* ``with_ordinal`` / ``with_previous`` number or compare rows in a global order
  without pulling the table into one task.
* ``stored`` writes a narrow table to the shared folder and reads it back column by column; ``gathered`` does so
  part by part, ``discard`` deletes such a table, and ``passing_shuffles`` frees the shuffle files of each part.
* ``maybe_member`` tells without a shuffle which rows surely have no partner.
* ``lookup`` joins a fact table to a keyed table when one key may hold a large
  share of the facts.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Keys given the map-side path in ``lookup``: any key outside the HOT_KEYS most
# frequent ones holds less than 1/HOT_KEYS of the facts.
HOT_KEYS = 2000
# Bits of the membership bitmap in ``maybe_member`` per key, and in all at most: 32 MB are
# broadcast, however many keys there are. Keys beyond that only mean that more rows
# take the exact, shuffled way: at 2^28 bits, 6 % of the others for 2^24 keys, 63 % for 2^28.
BITS_PER_KEY = 16
MOST_BITS = 1 << 28
BUCKET = 1 << 15
# Spark's switch to remove a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables next to the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet next to the checkpoints and read it back: computed once, pruned by column, and
    there again when an executor is lost."""
    return gathered([df], name)


def gathered(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of all parts (one at least, of one schema) as one stored table; a part is computed and written before the next is asked for."""
    path = None
    for part in parts:
        path = path or shared_folder(part.sparkSession, f"{name}-{uuid.uuid4().hex}")
        part.write.mode("append").parquet(path)
        spark, schema = part.sparkSession, part.schema
    return spark.read.schema(schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a ``stored`` table that nothing reads any more."""
    spark = table.sparkSession
    files = table.inputFiles()
    if not files:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path
    place, shared = path(files[0]).getParent(), path(shared_folder(spark, "x")).getParent()
    if place.getParent().toUri().getPath() != shared.toUri().getPath():
        raise ValueError(f"not a stored table: {place}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files behind. Else those stay until the driver happens to collect its garbage, and
    the disk holds the files of all queries so far."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def maybe_member(df: DataFrame, keys: DataFrame, on: Sequence[str], bits: int | None = None) -> DataFrame:
    """Add ``_maybe``: False only where the row's key is surely not among ``keys``.

    The keys (a stored table, which is counted first) are folded into a bitmap sized by their number, in
    pieces of 4 KB that are broadcast; nothing is shuffled on the side of ``df``.
    """
    if bits is None:
        bits = min(MOST_BITS, max(BUCKET, 1 << (BITS_PER_KEY * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64(*on), F.lit(bits))
    bucket, place = F.floor(slot / BUCKET), F.pmod(slot, F.lit(BUCKET))
    pieces = keys.select(bucket.alias("_bucket"), place.alias("_place")).groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    marked = df.withColumns({"_probe": bucket, "_own": place}).join(F.broadcast(pieces), F.col("_probe") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_own") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(F.col("_own"), F.lit(8)).cast("int")) == 1, F.lit(False))
    return marked.select(*df.columns, hit.alias("_maybe"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash partition a table that is stored in fewer splits than there are cores.

    Tables with enough splits, which any large one has, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def _ordered(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range partition by ``order`` and pin partition number and row position.

    The checkpoint makes both columns facts, so a lost executor cannot move rows
    to another partition between the two reads that follow.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return checkpointed(
        ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"))
    )


def _with_offsets(tagged: DataFrame, partition_total: Column) -> DataFrame:
    """Add ``_offset``: the total over all earlier partitions (one row per partition)."""
    totals = tagged.groupBy("_part").agg(partition_total.alias("_total"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    return tagged.join(F.broadcast(offsets), "_part")


def with_ordinal(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 0) -> DataFrame:
    """Number all rows ``start, start+1, ...`` by ``order``."""
    tagged = _with_offsets(_ordered(df, order), F.count(F.lit(1)))
    within = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.withColumn(name, F.col("_offset") + within + F.lit(start)).drop("_part", "_row", "_offset")


def with_previous(df: DataFrame, order: Sequence[str | Column], columns: Sequence[str]) -> DataFrame:
    """Add ``prev_<column>`` from the row before in ``order`` over the whole table (NULL first).

    The first row of a partition takes the last row of the nearest earlier
    non-empty one, found in a table with one row per partition.
    """
    tagged = _ordered(df, order)
    ends = tagged.groupBy("_part").agg(F.max_by(F.struct(*columns), "_row").alias("_end"))
    earlier = ends.select("_part", F.lag("_end").over(W.orderBy("_part")).alias("_end"))
    within = W.partitionBy("_part").orderBy("_row")
    joined = tagged.join(F.broadcast(earlier), "_part")
    first = F.row_number().over(within) == 1
    previous = [
        F.when(first, F.col(f"_end.{c}")).otherwise(F.lag(c).over(within)).alias(f"prev_{c}") for c in columns
    ]
    return joined.select(*df.columns, *previous)


def lookup(facts: DataFrame, keyed: DataFrame, key: str, spread_by: str, weight: str | None = None, sparse: bool = False) -> DataFrame:
    """Left join ``facts`` to ``keyed`` (one row per non-negative integer ``key``).

    The HOT_KEYS keys with most facts are joined map-side from a table of at most
    that many rows; their facts then enter the shuffle join under negative keys
    made from ``spread_by``, which match nothing, so no reducer receives a hot
    key. Facts stay whole: the two results are coalesced column by column.

    ``weight`` names a column of ``keyed`` that already holds the number of facts
    per key (not saturated; ``_weight`` is left out of the result); without it the facts are counted first (combined map-side).
    """
    payload = [c for c in keyed.columns if c not in (key, "_weight")]
    if sparse:
        marked = maybe_member(facts, keyed.select(key), [key])
        found = lookup(marked.where("_maybe").drop("_maybe"), keyed, key, spread_by, weight)
        missed = marked.where("not _maybe").select(*facts.columns, *[F.lit(None).cast(keyed.schema[c].dataType).alias(c) for c in payload])
        return found.unionByName(missed)
    if weight is None:
        counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("_weight"))
        weighted, weight = keyed.join(counts, key), "_weight"
    else:
        weighted = keyed
    hot = weighted.orderBy(F.desc(weight), key).limit(HOT_KEYS)
    hot = hot.select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in payload])
    cold = keyed.select(F.col(key).alias("_cold_key"), *[F.col(c).alias(f"_cold_{c}") for c in payload])
    is_hot = F.col("_hot_key").isNotNull()
    scattered = F.lit(-1) - F.pmod(F.xxhash64(spread_by), F.lit(1 << 20))
    return (
        facts.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_probe", F.when(is_hot, scattered).otherwise(F.col(key)))
        .join(cold, F.col("_probe") == F.col("_cold_key"), "left")
        .select(
            *facts.columns,
            *[F.when(is_hot, F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in payload],
        )
    )
