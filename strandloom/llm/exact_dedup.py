"""Exact duplicates: group by a 128-bit content hash, compare bytes inside the groups, keep one row.

Only a narrow table (id, length, hashes) is shuffled for the groups. Texts move only
for the byte comparison, and only those that the bitmap of hashes with two or more
rows lets through; equal texts are combined before the shuffle, so a text held
by a third of all rows is one row per task there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import boxed, documents, maybe_member, scratch, text_of, without

# Characters that do not count: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"

SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm
  from documents),
k as (
  select doc_id, norm, count(*) over (partition by norm) as group_size,
         first_value(doc_id) over (partition by norm order by n desc, doc_id) as keep_id
  from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from k
"""


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def content_hash(norm: Column) -> Column:
    """The 128-bit hash, 16 bytes."""
    return F.unhex(F.md5(norm))


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Size and best row of each group: most code points, then smallest id (null ids last)."""
    order = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.min(order)["doc_id"].alias("keep_id"))


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's columns; the groups have one row per key, so a hot key's rows can be split."""
    named = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], "group_size", "keep_id")
    return rows.join(named, [F.col(k) == F.col(f"_g_{k}") for k in keys]).drop(*[f"_g_{k}" for k in keys])


def exact_duplicates(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, content_hash.

    Texts are equal when they are after removing ``BLANKS``. The row with the most
    code points in its original text stays, then the one with the smallest doc_id.
    Null text counts as empty; empty texts are one group. Rows that share doc_id
    and text share the decision and count each in group_size. A null doc_id is
    last in order. Other columns, whatever their names, are ignored.

    ``hashed`` groups the rows; groups whose texts turn out to differ in bytes are
    formed anew by the texts themselves.
    """
    norm = normalised(text_of())
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.char_length(text_of()).alias("n_points"), norm.alias("norm"))
    texts = texts.withColumn("content_hash", hashed(F.col("norm")))
    rows = scratch(texts.select("doc_id", "n_points", "content_hash", F.unhex(F.sha2("norm", 256)).alias("sha")), "hashes")
    groups = scratch(_groups(rows, ["content_hash"]), "groups")

    several = groups.where("group_size > 1").select("content_hash")
    compared = maybe_member(texts.select("content_hash", "norm"), several, ["content_hash"]).where("_maybe")
    kinds = compared.groupBy("content_hash", "norm").agg(F.count(F.lit(1)).alias("n"))
    mixed = kinds.groupBy("content_hash").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("content_hash")
    mixed = scratch(mixed, "collisions")

    if mixed.isEmpty():
        found = _joined(rows, groups, ["content_hash"])
    else:
        keys = ["content_hash", "norm"]
        clash = texts.withColumn("sha", F.unhex(F.sha2("norm", 256))).join(mixed, "content_hash", "left_semi")
        exact = _joined(clash, _groups(clash, keys), keys).drop("norm")
        plain = _joined(rows.join(mixed, "content_hash", "left_anti"), groups, ["content_hash"])
        found = plain.unionByName(exact)
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "content_hash"
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).drop("content_hash")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, one row of each group of equal texts; a row repeated with its doc_id stays once."""
    found = exact_duplicates(docs)
    keyed = boxed(docs, id=F.col("doc_id").cast("bigint"), sha=F.sha2(normalised(text_of()), 256))
    several = scratch(found.where("group_size > 1").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "kept"), "copies")
    keyed = without(keyed, several.where("not kept"), ["id", "sha"])
    again = several.where("kept").groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():
        marked = maybe_member(keyed, again, ["id", "sha"])
        once = marked.where("_maybe").dropDuplicates(["id", "sha"])
        keyed = marked.where("not _maybe").unionByName(once)
    return keyed.select("_row.*")
