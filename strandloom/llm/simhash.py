"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code on the 64 bits: the perfect Hamming
code on bits 0 to 62 (every point lies within its covering radius 1 of exactly
one anchor) times the plain bit 63. Two fingerprints at most two bits apart have
a midpoint within one bit of both; the midpoint lies within the covering radius of
its anchor, so both fingerprints lie within the covering radius plus half the
threshold of that anchor. Each fingerprint is therefore replicated to all anchors
at that reach: 33 copies (2 if the fingerprint is an anchor on its 63 bits), and every
linked pair meets at an anchor. Taking the full threshold instead would also be
right, but would need some 650 copies for the same pairs.

An anchor's group holds at most the 2,081 distinct fingerprints around it, however
skewed the data: equal fingerprints are one row, and the ball is finite.
Inside a group fingerprints are compared by XOR, and a spanning set of links
(member, least member it reaches) leaves it, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import boxed, components, documents, once, scratch, text_of, without

WORDS = 3
SEED = 42
THRESHOLD = 2
# Hashes whose bits are counted at once; bounds the memory of a very long text.
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits of the XXH64 values of a text's shingles, as a signed 64-bit integer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = iter([b" ".join(tokens)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
        total = len(tokens) - words + 1
    digest, counts, left = xxhash.xxh64_intdigest, np.zeros(64, np.int64), total
    while left:
        n = min(left, CHUNK)
        hashes = np.fromiter((digest(s, SEED) for s in islice(shingles, n)), "<u8", n)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= n
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<i8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, the text, gives way to its fingerprint; the others stay."""
    for batch in batches:
        values = [fingerprint(text.as_py()) for text in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.int64())], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint ``fp`` of every whole text; null counts as empty."""
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return narrow.mapInArrow(_fingerprint_batches, "doc_id bigint, fp bigint")


def text_key() -> Column:
    """128-bit hash of the whole text as it stands; tells rows with one doc_id apart."""
    return F.unhex(F.md5(text_of()))


def _syndrome(fp: Column) -> Column:
    """Position (1 to 63) of the bit to flip to reach the Hamming code word, 0 for a code word."""
    masks = [sum(1 << (p - 1) for p in range(1, 64) if p >> k & 1) for k in range(6)]
    bits = [F.pmod(F.bit_count(fp.bitwiseAND(F.lit(m))), F.lit(2)) * (1 << k) for k, m in enumerate(masks)]
    return sum(bits[1:], bits[0]).cast("int")


def _reach_masks() -> list[list[int]]:
    """For each syndrome, what to XOR to get all anchors within covering radius plus one."""
    top = -(1 << 63)
    flip = [0] + [1 << (p - 1) for p in range(1, 64)]
    pairs = [[flip[i] | flip[i ^ s] for i in range(1, 64) if i < i ^ s] if s else [] for s in range(64)]
    return [[flip[s], flip[s] | top] + pairs[s] for s in range(64)]


def anchored(distinct: DataFrame) -> DataFrame:
    """(anchor, fp) for every anchor that a fingerprint is replicated to."""
    table = F.array(*[F.array(*[F.lit(m).cast("bigint") for m in masks]) for masks in _reach_masks()])
    near = distinct.select("fp", F.explode(F.element_at(table, _syndrome(F.col("fp")) + 1)).alias("mask"))
    return near.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("anchor"), "fp")


def _group_links(members: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one anchor's distinct members (at most 2,081), compared pair by pair."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= threshold
    label = np.arange(len(members))
    while True:
        step = np.where(near, label[None, :], len(members)).min(axis=1)
        if (step == label).all():
            break
        label = step
    linked = label != np.arange(len(members))
    return members[linked], members[label[linked]]


def _link_batches(threshold: int):
    def links(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(anchor)])
        two = starts[sizes == 2]
        close = np.bitwise_count(fp[two] ^ fp[two + 1]) <= threshold
        found = [(fp[two + 1][close], fp[two][close])]
        found += [_group_links(fp[s : s + n], threshold) for s, n in zip(starts[sizes > 2], sizes[sizes > 2])]
        u, v = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
        pairs = np.unique(np.stack([u, v], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            anchor = np.concatenate([anchor, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if len(anchor):
                # The last anchor's group may go on in the next batch.
                done = int(np.searchsorted(anchor, anchor[-1], "left"))
                yield links(anchor[:done], fp[:done])
                anchor, fp = anchor[done:], fp[done:]
        yield links(anchor, fp)

    return run


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (u, v) between distinct fingerprints that span all pairs at most ``threshold`` (1 or 2) bits apart."""
    if not 0 < threshold <= 2:
        raise ValueError("the reach of the anchors covers one or two differing bits")
    groups = anchored(distinct).repartition("anchor").sortWithinPartitions("anchor")
    return groups.mapInArrow(_link_batches(threshold), "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at most ``threshold`` bits apart are linked; component_id is the
    smallest doc_id of the connected component. Texts without a word have
    fingerprint zero and are linked like others. Null text counts as empty; rows
    with null or repeated doc_id are rows of their own, a null id is never a
    component_id unless the component has no other; other columns are ignored.
    """
    prints = scratch(fingerprints(docs), "fingerprints")
    classes = _classes(prints, threshold).select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(prints: DataFrame, threshold: int) -> DataFrame:
    """Per distinct fingerprint ``fp``: the component's ``root`` (a fingerprint) and component_id."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    member = components(links(least.select("fp"), threshold))
    rooted = least.join(member, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = scratch(rooted, "roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, exactly one of each component.

    The one with the smallest doc_id stays (a null id only where there is no other), of several texts
    with that id the one with the least text hash, of equal rows any one. Rows are told apart by id and text, so an id that
    stands for texts of several components keeps one row in each that it leads. Null text counts as empty, and all
    texts without a word are one component. An empty table stays empty; other columns pass through whatever their names.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    prints = scratch(narrow.mapInArrow(_fingerprint_batches, "doc_id bigint, key binary, fp bigint"), "fingerprints")
    classes = scratch(_classes(prints, THRESHOLD), "classes")
    found = prints.join(classes, "fp").select("doc_id", "key", "root", "component_id")
    leads = F.col("doc_id").eqNullSafe(F.col("component_id"))
    best = found.where(leads).groupBy(F.col("root").alias("_root")).agg(F.min("key").alias("_best"))
    told = found.where(leads).join(best, F.col("root") == F.col("_root")).select("doc_id", "key", (F.col("key") == F.col("_best")).alias("kept"))
    told = scratch(told.unionByName(found.where(~leads).select("doc_id", "key", F.lit(False).alias("kept"))), "near-copies")
    rows = boxed(docs, doc_id=F.col("doc_id").cast("bigint"), key=text_key())
    rows = without(rows, told.where("not kept"), ["doc_id", "key"])
    again = told.where("kept").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return once(rows, again, ["doc_id", "key"]).select("_row.*")
