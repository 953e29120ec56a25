"""Consecutive ids for distinct values and removal of consecutive duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import with_ordinal, with_previous


def encode_first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with ids 0, 1, ... in order of first appearance."""
    first = rows.groupBy(value).agg(F.min(order).alias("first_seen"))
    return with_ordinal(first, ["first_seen", value], "id")


def drop_consecutive(rows: DataFrame, order: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Keep the first row of each run of rows equal in ``same``."""
    marked = with_previous(rows, order, same)
    repeated = F.lit(True)
    for column in same:
        repeated = repeated & F.col(column).eqNullSafe(F.col(f"prev_{column}"))
    return marked.where(~repeated).select(*rows.columns)
