"""Chat formatting by rotating perspectives, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as
the assistant and all others as named users; the mask covers what the assistant says.

A dialogue comes in parts of at most ``PART`` turns, cut by the rank of a turn within its conversation; turns
without a number come last. So no row ever holds more than ``PART`` turns, whatever their numbers. Conversations of at most
``HOT_ROWS`` rows are ranked by a window, from which parts and renderings follow without another shuffle of
the texts. Rows of longer ones are numbered in a global order over many tasks, and their joins are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.llm.common import maybe_member, scratch
from strandloom.session import with_ordinal

# Turns per part.
PART = 64
# Rows of a conversation from which on it is ranked over many tasks, and salts of its joins.
HOT_ROWS = 4096
SALTS = 64
END = "<|end|>"

SQL = """
with t as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as text from conversations),
turns as (
  select *, cast((row_number() over (partition by conv_id order by turn nulls last, role, text) - 1) // 64 as bigint) as part from t),
speakers as (select distinct conv_id, role as speaker from turns),
seen as (
  select s.conv_id, s.speaker, part, turn, role, text, role = speaker as own,
         case when role = speaker then '<|assistant|>' || chr(10) else '<|user name=' || role || '|>' || chr(10) end as head
  from turns join speakers s on turns.conv_id is not distinct from s.conv_id),
placed as (
  select *, sum(length(head) + length(text) + 8) over (partition by conv_id, speaker, part order by turn nulls last, role, text) - length(text) - 8 as start from seen)
select conv_id, speaker, part, count(*) as n_turns,
       string_agg(head || text || '<|end|>' || chr(10), '' order by turn nulls last, role, text) as rendered,
       coalesce(string_agg(cast(start as bigint) || ':' || cast(start + length(text) + 7 as bigint), ',' order by turn nulls last, role, text) filter (own), '') as mask
from placed group by conv_id, speaker, part
"""


def _safe(text: Column) -> Column:
    """Markers inside a text lose their meaning."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _order() -> list[Column]:
    return [F.asc_nulls_last("turn"), F.asc("role"), F.asc("text")]


def _parts(ranked: DataFrame) -> DataFrame:
    """(conv, part, turns) from rows with their rank within the conversation."""
    turns = F.sort_array(F.collect_list(F.struct("rank", "role", "text")))
    return ranked.withColumn("part", F.floor(F.col("rank") / PART)).groupBy("conv", "part").agg(turns.alias("turns"))


def _short(rows: DataFrame) -> DataFrame:
    """(conv, part, turns, speaker) of conversations that one task holds; the texts are shuffled once, by conversation."""
    distinct = rows.repartition("conv").dropDuplicates(["conv", "turn", "role", "text"])
    ranked = distinct.withColumn("rank", F.row_number().over(W.partitionBy("conv").orderBy(*_order())).cast("bigint") - 1)
    speakers = rows.select(F.col("conv").alias("_conv"), F.col("role").alias("speaker")).distinct()
    return _parts(ranked).join(speakers, F.col("conv") == F.col("_conv")).select("conv", "part", "turns", "speaker")


def _long(rows: DataFrame) -> DataFrame:
    """The same for conversations of any length: no task holds one as a whole."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    ordered = with_ordinal(rows.distinct(), [F.col("conv"), *_order()], "ordinal").withColumn("salt", F.pmod("ordinal", F.lit(SALTS)).cast("int"))
    starts = ordered.groupBy(F.col("conv").alias("_conv")).agg(F.min("ordinal").alias("start")).withColumn("_salt", salts)
    ranked = ordered.join(starts, (F.col("conv") == F.col("_conv")) & (F.col("salt") == F.col("_salt")))
    ranked = ranked.select("conv", "turn", "role", "text", (F.col("ordinal") - F.col("start")).alias("rank"))
    speakers = rows.select(F.col("conv").alias("_conv"), F.col("role").alias("speaker")).distinct().withColumn("_salt", salts)
    salted = _parts(ranked).withColumn("salt", F.pmod("part", F.lit(SALTS)).cast("int"))
    return salted.join(speakers, (F.col("conv") == F.col("_conv")) & (F.col("salt") == F.col("_salt"))).select("conv", "part", "turns", "speaker")


def rotated(turns: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per conversation, speaker and part: conv_id, speaker, part, n_turns, rendered, mask.

    ``turns`` has conv_id, turn, role, text. Turns are ordered by number (those without one last), role and text, and
    ``part`` is the rank in that order // ``PART``; parts in order make the dialogue. ``mask`` lists start:end of
    the assistant's texts with their end marks, in code points of the part, end exclusive; it is empty in parts
    where the speaker is silent. A repeated row is one turn. A null role is the speaker ``unknown``, a
    null text is empty, rows without conv_id are one conversation. An empty table gives no rows. Other columns are ignored.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("unknown")), _safe(F.coalesce(F.col("text").cast("string"), F.lit("")))
    # As a struct, conversations without an id equal each other in joins.
    rows = turns.select(F.struct("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    hot = scratch(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("conv"), "long-conversations")
    if hot.isEmpty():
        seen = _short(rows)
    else:
        marked = maybe_member(rows, hot, ["conv"])
        seen = _short(marked.where("not _maybe").drop("_maybe")).unionByName(_long(marked.where("_maybe").drop("_maybe")))

    def rendered(t: Column) -> Column:
        head = F.when(t["role"] == F.col("speaker"), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n")))
        return F.struct((t["role"] == F.col("speaker")).alias("own"), head.alias("head"), F.concat(t["text"], F.lit(END)).alias("body"))

    lines = F.transform("turns", rendered)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def grown(state: Column, line: Column) -> Column:
        start = state["at"] + F.char_length(line["head"])
        stop = start + F.char_length(line["body"])
        span = F.array(F.concat_ws(":", start, stop))
        return F.struct((stop + 1).alias("at"), F.when(line["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    joined = F.array_join(F.transform("lines", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    mask = F.array_join(F.aggregate("lines", empty, grown)["spans"], ",")
    return seen.withColumn("lines", lines).select(
        F.col("conv.conv_id").alias("conv_id"), "speaker", "part", F.size("lines").cast("bigint").alias("n_turns"), joined.alias("rendered"), mask.alias("mask")
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
