"""URL filters by dated lists: every capture against the entries active when it was fetched.

Dated additions and removals of a pattern become validity intervals. A capture asks for
its host, the host's parent domains and its first path segment, joined as of the fetch
date. The join key is pattern and month, so that a host with a third of all captures is
spread over the months and each capture meets only the intervals of its own month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)"
SEGMENT = r"^[a-z][a-z0-9+.-]*://[^/?#]+(/[^/?#]+)"
FIRST_DAY = "2020-01-01"

SQL = r"""
with h as (
  select page_id, url, lower(url) as low,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1) as host,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]+(/[^/?#]+)', 1) as segment,
         date '2020-01-01' + cast((page_id * 37) % 1461 as integer) as fetched_on
  from pages),
hosts as (
  select distinct host, ord(substr(host, length(host) // 2 + 1, 1)) + length(host) * 31 as s from h where host <> ''),
sections as (select distinct host || segment as pattern, length(host || segment) * 17 + ord(right(segment, 1)) as s from h where segment <> '' and length(segment) = 3),
entries as (
  select 'block' as list, host as pattern, 'add' as action, date '2020-01-01' + cast(s * 7 % 700 as integer) as listed_on from hosts where s % 4 <> 0
  union all select 'block', host, 'remove', date '2020-01-01' + cast(s * 7 % 700 + 100 + s % 300 as integer) from hosts where s % 4 <> 0
  union all select 'block', host, 'add', date '2020-01-01' + cast(s * 7 % 700 + 550 + s % 200 as integer) from hosts where s % 4 = 1
  union all select 'allow', pattern, 'add', date '2020-01-01' + cast(s * 11 % 1000 as integer) from sections where s % 3 = 0
  union all select 'allow', pattern, 'remove', date '2020-01-01' + cast(s * 11 % 1000 + 200 as integer) from sections where s % 3 = 0),
days as (select list, pattern, listed_on, bool_or(action = 'remove') as removed from entries group by all),
intervals as (
  select list, pattern, listed_on, lead(listed_on) over (partition by list, pattern order by listed_on) as until, removed from days),
keys as (
  select page_id, url, fetched_on, array_to_string(list_slice(string_split(host, '.'), i, 99), '.') as pattern
  from (select *, unnest(range(1, len(string_split(host, '.')) + 1)) as i from h where host <> '')
  union select page_id, url, fetched_on, host || segment from h where host <> '' and segment <> ''),
hits as (
  select k.page_id, i.list, i.pattern, i.listed_on,
         row_number() over (partition by k.page_id order by length(i.pattern) desc, i.listed_on desc, i.list, i.pattern) as place,
         count(*) over (partition by k.page_id) as n_active
  from keys k join intervals i on k.pattern = i.pattern and not i.removed and k.fetched_on >= i.listed_on and (i.until is null or k.fetched_on < i.until))
select h.page_id, h.fetched_on, coalesce(list = 'block', false) as blocked, list, pattern, listed_on, coalesce(n_active, 0) as n_active
from h left join (select * from hits where place = 1) using (page_id)
"""


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, listed_on, until (exclusive; null: still open) of every time a pattern was listed.

    ``entries`` has list, pattern, action (add or remove) and listed_on. Entries repeat
    harmlessly; on a day with both actions the removal holds; another addition while listed starts a
    new interval. Entries with a null are left out: they say nothing about any time or page.
    """
    known = entries.where("list is not null and pattern is not null and listed_on is not null and action in ('add', 'remove')")
    days = known.groupBy("list", "pattern", "listed_on").agg(F.bool_or(F.col("action") == "remove").alias("removed"))
    after = F.lead("listed_on").over(W.partitionBy("list", "pattern").orderBy("listed_on"))
    return days.withColumn("until", after).where("not removed").drop("removed")


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), HOST, 1)


def patterns_of(url: Column) -> Column:
    """Patterns that may list a URL: its host, the parent domains, and the host with the first path segment."""
    labels, segment = F.split(host_of(url), r"\."), F.regexp_extract(F.lower(url), SEGMENT, 1)
    domains = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    section = F.when(segment != "", F.array(F.concat(host_of(url), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(domains, section)))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Per capture (page_id, url, fetched_on): the entry that decides and how many are active.

    Returns page_id, fetched_on, blocked, list, pattern, listed_on, n_active. The longest
    pattern decides, then the latest listing, then the first list and pattern by name; ``blocked``
    says whether the deciding list is ``block``. Captures without a host, a date or an active
    entry are not blocked, with nulls and n_active 0. Repeated captures are evaluated alike.
    """

    def month(day: Column) -> Column:
        return F.year(day) * 12 + F.month(day)

    given = captures.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("fetched_on").cast("date").alias("fetched_on"))
    span = given.agg(F.min("fetched_on").alias("since"), F.max("fetched_on").alias("last"))
    asked = given.where("fetched_on is not null").select("url", "fetched_on").distinct()
    asked = asked.select("url", "fetched_on", F.explode(patterns_of(F.col("url"))).alias("pattern")).withColumn("month", month(F.col("fetched_on")))
    # Months outside the captures' dates cannot match; the join with their one row cuts open intervals.
    active = intervals(entries).join(F.broadcast(span), F.col("listed_on") <= F.col("last"))
    low, high = month(F.greatest("listed_on", "since")), month(F.least(F.coalesce(F.date_sub("until", 1), "last"), "last"))
    active = active.where(low <= high).withColumn("month", F.explode(F.sequence(low, high))).select(
        F.col("pattern").alias("_pattern"), F.col("month").alias("_month"), "list", "listed_on", "until"
    )
    met = asked.join(active, (F.col("pattern") == F.col("_pattern")) & (F.col("month") == F.col("_month")))
    met = met.where((F.col("fetched_on") >= F.col("listed_on")) & (F.col("until").isNull() | (F.col("fetched_on") < F.col("until"))))
    order = F.struct((-F.char_length("pattern")).alias("l"), (-F.unix_date("listed_on")).alias("d"), "list", "pattern", "listed_on")
    decided = met.groupBy(F.col("url").alias("_url"), F.col("fetched_on").alias("_on")).agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n_active"))
    joined = given.join(decided, (F.col("url") == F.col("_url")) & (F.col("fetched_on") == F.col("_on")), "left")
    best = [F.col(f"best.{c}").alias(c) for c in ("list", "pattern", "listed_on")]
    blocked = F.coalesce(F.col("best.list") == "block", F.lit(False)).alias("blocked")
    return joined.select("page_id", "fetched_on", blocked, *best, F.coalesce("n_active", F.lit(0).cast("bigint")).alias("n_active"))


def dated_pages(pages: DataFrame) -> DataFrame:
    """Captures with a fetch date, which the table lacks, derived from the page id."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(1461)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched_on"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list of the pages' own hosts and sections: added, removed, some added again."""

    def dated(rows: DataFrame, name: str, action: str, days: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("list"), "pattern", F.lit(action).alias("action"), F.date_add(F.lit(FIRST_DAY).cast("date"), days.cast("int")).alias("listed_on"))

    s = F.col("s")
    host, segment = host_of(F.col("url")), F.regexp_extract(F.lower("url"), SEGMENT, 1)
    middle = F.substr("pattern", F.floor(F.char_length("pattern") / 2).cast("int") + 1, F.lit(1))
    hosts = pages.select(host.alias("pattern")).where("pattern <> ''").distinct().withColumn("s", F.ascii(middle) + F.char_length("pattern") * 31)
    sections = pages.where((F.char_length(segment) == 3) & (host != "")).select(F.concat(host, segment).alias("pattern")).distinct()
    sections = sections.withColumn("s", F.char_length("pattern") * 17 + F.ascii(F.right("pattern", F.lit(1))))
    start, again = hosts.where(s % 4 != 0), hosts.where(s % 4 == 1)
    allowed = sections.where(s % 3 == 0)
    parts = [
        dated(start, "block", "add", s * 7 % 700),
        dated(start, "block", "remove", s * 7 % 700 + 100 + s % 300),
        dated(again, "block", "add", s * 7 % 700 + 550 + s % 200),
        dated(allowed, "allow", "add", s * 11 % 1000),
        dated(allowed, "allow", "remove", s * 11 % 1000 + 200),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return evaluate(dated_pages(pages), derived_entries(pages))
