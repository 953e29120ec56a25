"""Text lines with a reproducible order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.functions import kernel
from strandloom.session import checkpointed, shared_folder

ORDER = ("_file", "_block", "_line")


def read_lines(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """``value`` plus ORDER columns: file, split offset, position in the split.

    Files stay splittable (gzip ones are read whole by one task each).
    """
    options = {"lineSep": separator} if separator else {}
    return spark.read.text(path, **options).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def placed(lines: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Number lines in file order (files by path) without moving them; also ``_rank``, a line's place in its split.

    Lines of one split sit together in one scan partition, so a line's rank in its
    split is a difference of row positions, and only one row per split (count and
    first position) is gathered and broadcast. Lines left out beforehand must not
    lie between kept ones of the same split.
    """
    splits = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_first"))
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.lit(start)
    offsets = checkpointed(splits.select("_file", "_block", "_first", offset.alias("_offset")))
    rank = F.col("_line") - F.col("_first")
    return lines.join(F.broadcast(offsets), ["_file", "_block"]).select((F.col("_offset") + rank).alias(name), rank.alias("_rank"), "value")


def number(lines: DataFrame, name: str, start: int = 0) -> DataFrame:
    """``placed`` without the ranks."""
    return placed(lines, name, start).select(name, "value")


def split_totals(lines: DataFrame, counts: dict[str, Column], carried: dict[str, Column] = {}) -> DataFrame:
    """One row per file split: sums of ``counts`` and the last value of each of ``carried`` (text)."""
    columns = [c.cast("bigint").alias(n) for n, c in counts.items()] + [c.cast("string").alias(n) for n, c in carried.items()]
    sums = [F.sum(n).alias(n) for n in counts]
    if not carried:
        return lines.select("_file", "_block", *columns).groupBy("_file", "_block").agg(*sums)
    valued = lines.select("_file", "_block", "_line", *columns)
    runs = valued.mapInArrow(kernel.split_totals(list(counts), list(carried)), valued.schema)
    last = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_line"))).alias(n) for n in carried]
    return runs.groupBy("_file", "_block").agg(*sums, *last)


def running_counts(
    lines: DataFrame, counts: dict[str, Column], carried: dict[str, Column] = {}, start: DataFrame | None = None
) -> DataFrame:
    """Running totals in file order, one new column each, without moving the lines; of ``carried``
    columns the last value so far.

    Totals within a split come from one ordered pass over its scan partition; one
    row per split then adds what lies before it. ``start`` has that for the
    beginning of each file (``_file`` and the same columns), where only some files are read.
    """
    valued = lines.select(
        "value", "_file", "_block", *[c.cast("bigint").alias(n) for n, c in counts.items()], *[c.cast("string").alias(n) for n, c in carried.items()]
    )
    splits = split_totals(lines, counts, carried)
    order = W.orderBy("_file", "_block") if start is None else W.partitionBy("_file").orderBy("_block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select(
        "_file",
        "_block",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in counts],
        *[F.last(n, ignorenulls=True).over(before).alias(f"_before_{n}") for n in carried],
    )
    if start is not None:
        known = start.select("_file", *[F.col(n).alias(f"_start_{n}") for n in (*counts, *carried)])
        offsets = offsets.join(known, "_file").select(
            "_file",
            "_block",
            *[(F.col(f"_before_{n}") + F.col(f"_start_{n}")).alias(f"_before_{n}") for n in counts],
            *[F.coalesce(f"_before_{n}", f"_start_{n}").alias(f"_before_{n}") for n in carried],
        )
    within = valued.mapInArrow(kernel.split_counter(list(counts), list(carried)), valued.schema)
    placed = within.join(F.broadcast(checkpointed(offsets)), ["_file", "_block"])
    return placed.select(
        "value",
        *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in counts],
        *[F.coalesce(n, f"_before_{n}").alias(n) for n in carried],
    )


def numbered_lines(spark: SparkSession, path: str, separator: str | None = None, start: int = 0) -> DataFrame:
    """``line_no`` in file order and ``value``."""
    return number(read_lines(spark, path, separator), "line_no", start)


def write_lines(lines: DataFrame, order: list[str], path: str, gzip: bool = False, files: int = 0) -> None:
    """Write ``value`` so that part files in name order hold the lines in ``order``; at least about ``files`` of them."""
    n = max(files, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_lines = lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select("value")
    sorted_lines.write.mode("overwrite").text(path, compression="gzip" if gzip else "none")


def head_lines(spark: SparkSession, path: str) -> Iterator[str]:
    """Lines from the start of the first file on; stop iterating to stop reading.

    Lines are fetched a few at a time, with a limit on the scan, so a large split never comes to the driver.
    """
    for name in sorted(spark.read.text(path).inputFiles()):
        lines, seen, wanted = spark.read.text(name), 0, 64
        while True:
            found = lines.take(wanted)
            for row in found[seen:]:
                yield row.value
            if len(found) < wanted:
                break
            seen, wanted = wanted, 4 * wanted


def scratch_path(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, f"{name}-{uuid.uuid4().hex}")
