"""How filters interact: what each order of applying them removes at each step, by decision diagrams.

Every document is reduced to its failure mask, one bit per filter, and masks are counted per
part. A part's counts form a decision diagram with one level per filter: a node sends
passing documents one way and failing ones the other, equal sub-diagrams are one node, and every node
carries the counts of all documents below it. Swapping two neighbouring levels only rebuilds
these two and leaves every count of a node as it is, so a run of such swaps visits all orders of the
filters. In each order the path on which everything passes shows the order's steps: a
node's failing side is what that step removes.

Texts never leave the scan. What is shuffled is one narrow row per document for the table-wide
search of identical texts and the labels, then counts of at most 2^filters masks per part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import documents, scratch, text_of

FILTERS = "ABCDE"
LEAST_WORDS = 200
COUNTS = ("n", "good", "toxic")
OUT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)
Weight = tuple[int, int, int]

SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
marks as (
  select part, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
         coalesce(doc_id > min(doc_id) over (partition by text), false) as e, doc_id from d),
known as (
  select doc_id, coalesce(max(quality) = 1, false) as good, coalesce(max(toxic) = 1, false) as toxic
  from labels where doc_id is not null group by doc_id),
masks as (
  select part, [a, b, c, d, e] as fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from marks left join known using (doc_id) group by all),
letters as (select unnest(range(1, 6)) as l),
orders as (
  select [p.l, q.l, r.l, s.l, t.l] as o from letters p, letters q, letters r, letters s, letters t
  where len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
steps as (select o, unnest(range(1, 6)) as step from orders),
each as (
  select part, o, step, n, good, toxic, fails[o[step]] as failing,
         list_bool_or(list_transform(o[1:step - 1], lambda x: fails[x])) as earlier,
         len(list_filter(fails, lambda x: x)) = 1 as alone
  from steps cross join masks),
sums as (
  select part, o, step, cast(coalesce(sum(n) filter (not coalesce(earlier, false) and not failing), 0) as bigint) as kept,
         cast(coalesce(sum(n) filter (not coalesce(earlier, false) and failing), 0) as bigint) as removed,
         cast(coalesce(sum(n) filter (earlier and failing), 0) as bigint) as redundant,
         cast(coalesce(sum(n) filter (failing and alone), 0) as bigint) as unique_fails,
         cast(coalesce(sum(good) filter (not coalesce(earlier, false) and failing), 0) as bigint) as good_lost,
         cast(coalesce(sum(toxic) filter (not coalesce(earlier, false) and failing), 0) as bigint) as toxic_lost
  from each group by all)
select part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') as filter_order, cast(step as int) as step, kept, removed, redundant,
       unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, o[step]) as bigint) as shapley
from sums
"""


class Diagram:
    """Decision diagram over failure masks; the leaves are counts, and every node is [passing, failing, counts].

    All levels are kept (a node whose two sides are equal stays), so a path has one node per filter.
    """

    def __init__(self, filters: str, counts: dict[int, Weight]):
        self.order = list(filters)
        self.levels: list[list[list]] = [[] for _ in filters]
        self.leaves: dict[Weight, tuple] = {}
        self.root = self._build(0, 0, counts, {})

    def _leaf(self, weight: Weight) -> tuple:
        return self.leaves.setdefault(weight, (None, None, weight))

    def _node(self, level: int, passing, failing, known: dict):
        key = (id(passing), id(failing))
        if key not in known:
            known[key] = [passing, failing, tuple(a + b for a, b in zip(passing[2], failing[2]))]
            self.levels[level].append(known[key])
        return known[key]

    def _build(self, level: int, mask: int, counts: dict[int, Weight], known: dict):
        if level == len(self.order):
            return self._leaf(counts.get(mask, (0,) * len(COUNTS)))
        sides = [self._build(level + 1, mask | bit << level, counts, known) for bit in (0, 1)]
        return self._node(level, *sides, known.setdefault(level, {}))

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next one; nodes above keep their children and counts."""
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        self.levels[level + 1], known = [], {}
        for node in self.levels[level]:
            passing, failing, _ = node
            node[0] = self._node(level + 1, passing[0], failing[0], known)
            node[1] = self._node(level + 1, passing[1], failing[1], known)

    def passing_path(self) -> Iterator[tuple[str, Weight, Weight]]:
        """Per step: the filter, what passes this and all before, what it removes."""
        node = self.root
        for name in self.order:
            yield name, node[0][2], node[1][2]
            node = node[0]


def plain_changes(n: int) -> Iterator[int]:
    """Places of the n! - 1 swaps of neighbours that run through all orders of n things."""
    if n < 2:
        return
    leftward = True
    for inner in [*plain_changes(n - 1), None]:
        yield from range(n - 2, -1, -1) if leftward else range(n - 1)
        if inner is not None:
            yield inner + leftward
        leftward = not leftward


def audit_counts(counts: dict[int, Weight], filters: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the filters.

    Bit k of a mask stands for the k-th filter.
    """
    diagram = Diagram(filters, counts)
    paths = {"".join(diagram.order): list(diagram.passing_path())}
    for place in plain_changes(len(filters)):
        diagram.swap(place)
        paths["".join(diagram.order)] = list(diagram.passing_path())
    failing, alone, shapley = {}, {}, dict.fromkeys(filters, 0)
    for path in paths.values():
        failing[path[0][0]] = path[0][2][0]
        alone[path[-1][0]] = path[-1][2][0]
        for name, _, removed in path:
            shapley[name] += removed[0]
    return [
        (order, step, kept[0], removed[0], failing[name] - removed[0], alone[name], removed[1], removed[2], shapley[name])
        for order, path in paths.items()
        for step, (name, kept, removed) in enumerate(path, 1)
    ]


def text_failures() -> dict[str, Column]:
    """The filters that look at one text, over a column ``text`` without nulls and its ``words``."""
    return {
        "A": F.size("words") < LEAST_WORDS,
        "B": F.size(F.array_distinct("words")) * 100 < F.size("words") * 50,
        "C": F.char_length(F.regexp_replace("text", "[^A-Z]+", "")) * 100 > F.char_length("text") * 2,
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the counts n, good, toxic: how many documents of a part fail just these filters.

    Null source is the part '', null text counts as empty. A document with a null id
    is never a later copy and has no label; rows that repeat an id and a text are copies only of smaller ids.
    A document labelled twice has the greater of each label. Other columns are ignored.
    """
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    worded = named.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), ""))
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_failures().values())]
    rows = worded.select("doc_id", "part", sum(bits[1:], bits[0]).alias("own"), F.unhex(F.sha2("text", 256)).alias("sha"))
    rows = scratch(rows, "failures")
    named = rows.where("doc_id is not null")
    # Joined on text and id, so the copies of one text are spread; equal rows are combined before.
    each = named.groupBy("doc_id", "sha", "part", "own").agg(F.count(F.lit(1)).alias("n"))
    first = named.groupBy(F.col("sha").alias("_sha")).agg(F.min("doc_id").alias("_first"))
    later = F.when(F.col("_first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    masked = each.join(first, (F.col("sha") == F.col("_sha")) & (F.col("doc_id") == F.col("_first")), "left").select("doc_id", "part", (F.col("own") + later).alias("mask"), "n")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(*[(F.max(c) == 1).alias(f"_{c}") for c in ("quality", "toxic")])
    told = masked.join(known, F.col("doc_id") == F.col("_id"), "left").select("part", "mask", "n", "_quality", "_toxic")
    no = F.lit(False)
    unnamed = rows.where("doc_id is null").select("part", F.col("own").alias("mask"), F.lit(1).cast("bigint").alias("n"), no.alias("_quality"), no.alias("_toxic"))
    counts = {"n": F.lit(True), "good": F.col("_quality"), "toxic": F.col("_toxic")}
    sums = [F.sum(F.when(counts[c], F.col("n")).otherwise(0)).alias(c) for c in COUNTS]
    return told.unionByName(unnamed).groupBy("part", "mask").agg(*sums)


def _audit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in OUT.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * (len(names) - 3)]
    for batch in batches:
        for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = audit_counts({m["mask"]: tuple(m[c] for c in COUNTS) for m in masks})
            columns = [[part] * len(rows), *zip(*rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def audit(masks: DataFrame) -> DataFrame:
    """All orders and steps of every part; a part's masks are at most 32 rows. No document, no rows."""
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks"))
    return parts.mapInArrow(_audit_batches, OUT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are the sources; the five filters in all 120 orders."""
    return audit(failure_masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))
