"""k-mer tables on disk: Parquet with its parameters, and the text exchange format."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import kmers as K
from strandloom.params import SketchParams
from strandloom.sources.lines import read_lines, write_lines

# The header of the text exchange format.
TEXT_HEADER = "modset bits {bits} size {size} k {k} w {w} seed {seed}"
TEXT_HEADER_PATTERN = r"^modset bits (\d+) size (\d+) k (\d+) w (\d+) seed (\d+)$"


def write_table(table: DataFrame, params: SketchParams, path: str) -> None:
    """One folder: ``rows`` (Parquet) and ``params`` (one JSON line)."""
    table.write.mode("overwrite").parquet(f"{path}/rows")
    one = table.sparkSession.range(1).select(*[F.lit(v).alias(n) for n, v in params.as_dict().items()])
    one.coalesce(1).write.mode("overwrite").json(f"{path}/params")


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, SketchParams]:
    stored = spark.read.schema("k int, w int, seed int").json(f"{path}/params").first()
    return spark.read.parquet(f"{path}/rows"), SketchParams(stored.k, stored.w, stored.seed)


def text_rows(table: DataFrame, params: SketchParams) -> DataFrame:
    """``idx`` and the tab-separated row text."""
    row = F.concat_ws("\t", "idx", K.decode(F.col("kmer"), params.k), "depth", "info")
    return table.select("idx", row.alias("value"))


def write_text(table: DataFrame, params: SketchParams, path: str, bits: int = 28) -> None:
    size = table.count() + 1
    header = TEXT_HEADER.format(bits=bits, size=size, **params.as_dict())
    first = table.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("idx"), F.lit(header).alias("value"))
    write_lines(first.unionByName(text_rows(table, params)), ["idx"], path)


def read_text(spark: SparkSession, path: str) -> tuple[DataFrame, SketchParams]:
    lines = read_lines(spark, path)
    header = lines.where(F.col("value").rlike(TEXT_HEADER_PATTERN)).select("value").first()
    if header is None:
        raise ValueError(f"no k-mer table header in {path}")
    _, _, k, w, seed = map(int, re.match(TEXT_HEADER_PATTERN, header.value).groups())
    field = F.split("value", "\t")
    rows = lines.where(~F.col("value").rlike(TEXT_HEADER_PATTERN)).select(
        field[0].cast("bigint").alias("idx"),
        K.encode(field[1]).alias("kmer"),
        field[2].cast("int").alias("depth"),
        field[3].cast("int").alias("info"),
    )
    return rows, SketchParams(k, w, seed)
