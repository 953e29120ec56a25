"""Helpers shared by the corpus operators: scratch tables, row removal, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import shared_folder

# Bits of the membership bitmap in ``maybe_member`` per key, and in all at most: 32 MB are
# broadcast, however many keys there are. Keys beyond that only mean that more rows
# take the exact, shuffled way: at 2^28 bits, 6 % of the others for 2^24 keys, 63 % for 2^28.
BITS_PER_KEY = 16
MOST_BITS = 1 << 28
BUCKET = 1 << 15


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet next to the checkpoints and read it back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


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


def boxed(df: DataFrame, **keys: Column) -> DataFrame:
    """The whole row as ``_row``, beside the given columns; no name of ``df`` can clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[v.alias(k) for k, v in keys.items()])


def without(rows: DataFrame, drop: DataFrame, on: Sequence[str]) -> DataFrame:
    """``rows`` (boxed, with the columns ``on``) whose key is not in ``drop``; null keys equal each other.

    Only rows that the bitmap of ``drop`` lets through are shuffled; the others,
    with their texts, stay where they are.
    """
    marked = maybe_member(rows, drop, on)
    stay = marked.where(~F.col("_maybe")).drop("_maybe")
    gone = drop.select(*[F.col(c).alias(f"_gone_{c}") for c in on]).distinct()
    match = [F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in on]
    check = marked.where("_maybe").drop("_maybe").join(gone, match, "left_anti")
    return stay.unionByName(check)


def once(rows: DataFrame, again: DataFrame, on: Sequence[str]) -> DataFrame:
    """``rows`` (boxed, with the columns ``on``), one of each key; ``again`` has the keys that may stand in several rows."""
    if again.isEmpty():
        return rows
    marked = maybe_member(rows, again, on)
    return marked.where("not _maybe").unionByName(marked.where("_maybe").dropDuplicates(list(on))).drop("_maybe")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (long columns u, v): ``node`` and ``root``, the least node of its component.

    Alternating large-star and small-star steps. Each is a minimum per node,
    combined map-side, and a join back on the node, whose hot keys the engine may
    split because the side with minima has one row per node. Every step is written
    to the shared folder. Ends when a round changes nothing: O(log^2) rounds.
    """
    u, v = F.col("u"), F.col("v")

    def hooked(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy(u.alias("n")).agg(F.min("v").alias("m"))
        return pairs.join(least, u == F.col("n")).select("u", "v", F.least("m", "u").alias("m"))

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first())

    edges = scratch(edges.where(u != v).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, now = None, state(edges)
    while now != before:
        around = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        large = hooked(around).where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        downward = hooked(scratch(large, "large-star"))
        small = downward.where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        edges = scratch(small.unionByName(downward.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, now = now, state(edges)
    members = edges.select(u.alias("node"), v.alias("root"))
    return members.unionByName(edges.select(v.alias("node"), v.alias("root")).distinct())
