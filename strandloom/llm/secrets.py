"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Patterns give candidates with their place in the text. The hash of each candidate's
value is counted over the whole corpus by distinct repositories and distinct owners.
A value in three or more repositories, or with three or more owners, is a widely copied example (``copied`` spans).
A value in one repository of one owner that looks random is a live-looking credential (``live`` spans). A value
between these, in two repositories of one or two owners, is ``shared``: neither an example nor one owner's own.
These spans lie on the value and stand beside the base spans.

Only matches leave the scan, in a narrow table; counting is combined map-side, so
an example copied into a third of all documents is one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.llm.common import documents, scratch, text_of

# The words of an assignment, each letter in either case.
NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
# Kinds in their order: pattern, group that holds the value, least length of that group.
KINDS = {
    "assign": (rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
ORDER = [*KINDS, "live", "copied", "shared"]
# Owners or repositories from which on a value is a copied example, and distinct characters of a live-looking value.
COPIED = 3
LIVE_CHARACTERS = 6

_MATCHES = "\n  union all\n".join(
    f"""  select rid, {k} as kind, unnest(range(len(m))) + 1 as i, unnest(m) as m, unnest(g) as g, unnest(p[1:len(m)]) as p from (
    select rid, regexp_extract_all(text, '{pattern.replace("'", "''")}', 0) as m, regexp_extract_all(text, '{pattern.replace("'", "''")}', {group}) as g,
           string_split_regex(text, '{pattern.replace("'", "''")}') as p from d)"""
    for k, (pattern, group, _) in enumerate(KINDS.values())
)
SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, source as owner,
    case when source is not null then (source, lang) end as repository from documents),
m as (
{_MATCHES}),
placed as (
  select *, sum(length(p) + length(m)) over (partition by rid, kind order by i) as stop from m),
good as (
  select rid, kind, stop - length(m) as start, stop, stop - length(g) as value_start, g as value from placed
  where length(g) >= case kind when 0 then 6 when 1 then 20 else 24 end),
seen as (
  select value, count(distinct owner) as owners, count(distinct repository) as repositories from good join d using (rid) group by value),
classed as (
  select value, owners, repositories, case when owners >= {COPIED} or repositories >= {COPIED} then 4 when owners > 1 or repositories > 1 then 5
    when owners = 1 and repositories = 1 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')
    and len(list_distinct(string_split(value, ''))) >= {LIVE_CHARACTERS} then 3 end as kind from seen),
marked as (
  select rid, classed.kind, value_start as start, stop from good join classed using (value) where classed.kind is not null),
spread as (
  select rid, max(owners) as max_owners, max(repositories) as max_repositories from good join classed using (value) group by rid),
every as (select rid, kind, start, stop from good union select rid, kind, start, stop from marked),
texts as (
  select rid, string_agg(['assign','access','hex','live','copied','shared'][kind + 1] || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, kind, stop) as spans,
    string_agg(['assign','access','hex'][kind + 1] || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, kind, stop) filter (kind < 3) as base,
    count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    count(*) filter (kind = 3) as n_live, count(*) filter (kind = 4) as n_copied, count(*) filter (kind = 5) as n_shared
  from every group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied,
  coalesce(n_shared, 0) as n_shared, coalesce(max_owners, 0) as max_owners, coalesce(max_repositories, 0) as max_repositories
from d left join texts using (rid) left join spread using (rid)
"""


def _matches(kind: int, text: Column) -> Column:
    """Array of (kind, i, gap before, size, value) of a pattern's matches; null without a match."""
    pattern, group, _ = [*KINDS.values()][kind]
    p = F.lit(pattern)
    gaps, found, values = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    whole = F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.char_length(F.element_at(gaps, i + 1)).alias("gap"), F.char_length(m).alias("size"), F.element_at(values, i + 1).alias("value")
        ),
    )
    return F.when(text.rlike(pattern), whole)


def candidates(docs: DataFrame, repository: Column, owner: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, matches): every document under a row number ``rid``, and the good matches with their places.

    The table with the matches is written to the shared folder, which makes ``rid`` a fact.
    """
    text = text_of()
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,value:string>>")
    hits = F.concat(*[F.coalesce(_matches(k, F.col("text")), none) for k in range(len(KINDS))])
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), repository.alias("repository"), owner.alias("owner"), text.alias("text"))
    rows = scratch(named.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "repository", "owner", hits.alias("hits")), "secret-matches")
    each = rows.where(F.size("hits") > 0).select("rid", "repository", "owner", F.explode("hits").alias("h")).select("rid", "repository", "owner", "h.*")
    so_far = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("rid", "kind").orderBy("i"))
    placed = each.withColumn("stop", so_far).withColumn("start", F.col("stop") - F.col("size"))
    least = F.element_at(F.array(*[F.lit(n) for _, _, n in KINDS.values()]), F.col("kind") + 1)
    good = placed.where(F.char_length("value") >= least).withColumn("value_start", F.col("stop") - F.char_length("value"))
    return rows.select("rid", "doc_id"), good.select("rid", "repository", "owner", "kind", "start", "stop", "value_start", "value", F.sha2("value", 256).alias("hash"))


def ownership(matches: DataFrame) -> DataFrame:
    """Per candidate hash: distinct repositories and owners in the whole corpus (null is none)."""
    return matches.groupBy("hash").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_shared, max_owners, max_repositories.

    Spans are kind:start:end in code points, end exclusive, by start, kind and end. The last two columns are the most owners
    and repositories that any of the document's values has in the corpus (0 without values). Null text counts
    as empty and gives no spans. Repeated rows get the same spans each. Unknown (null) owners and repositories do not
    count; a value without any known owner or repository is in no class. Other columns are ignored.
    """
    rows, matches = candidates(docs, repository, owner)
    value = F.col("value")
    random = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)
    held = matches.join(ownership(matches).withColumnRenamed("hash", "_hash"), F.col("hash") == F.col("_hash"))
    owners, repositories = F.col("owners"), F.col("repositories")
    extra = (
        F.when((owners >= COPIED) | (repositories >= COPIED), ORDER.index("copied"))
        .when((owners > 1) | (repositories > 1), ORDER.index("shared"))
        .when((owners == 1) & (repositories == 1) & random, ORDER.index("live"))
    )
    both = F.array(F.struct("kind", "start", "stop"), F.struct(extra.alias("kind"), F.col("value_start").alias("start"), F.col("stop")))
    spread = [F.max(c).alias(f"max_{c}") for c in ("owners", "repositories")]
    every = held.select("rid", "owners", "repositories", F.explode(both).alias("s")).where("s.kind is not null")
    every = every.groupBy("rid", "s").agg(F.max("owners").alias("owners"), F.max("repositories").alias("repositories")).select("rid", "s.*", "owners", "repositories")
    span = F.struct("start", "kind", "stop")
    grouped = every.groupBy("rid").agg(
        F.sort_array(F.collect_list(span)).alias("s"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{name}") for k, name in enumerate(ORDER)], *spread
    )
    names = F.array(*[F.lit(k) for k in ORDER])
    no_spans = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    all_ = F.coalesce("s", no_spans)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")

    base = joined(F.filter(all_, lambda s: s["kind"] < len(KINDS)))
    counts = {n: F.coalesce(f"n_{n}", F.lit(0).cast("bigint")).alias(f"n_{n}") for n in ORDER}
    return rows.join(grouped, "rid", "left").select(
        "doc_id", *[counts[k] for k in KINDS], F.sha2(base, 256).alias("base_sha256"), joined(all_).alias("spans"), *[counts[k] for k in ORDER[len(KINDS) :]],
        *[F.coalesce(f"max_{c}", F.lit(0).cast("bigint")).alias(f"max_{c}") for c in ("owners", "repositories")],
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner is a source, a repository what a source has in one language; without a source both are unknown."""
    return scan(documents(spark, sf_dir), F.when(F.col("source").isNotNull(), F.struct("source", "lang")), F.col("source"))
