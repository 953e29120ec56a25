"""Reference indexes and readsets kept as Parquet folders with their parameters.

Tables with one row per k-mer are bucketed and sorted by k-mer: a later join on the k-mer
moves the other side only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.mapping import reference_kmers
from strandloom.operators.readset import Readset
from strandloom.params import SketchParams


# k-mers per bucket of a stored table, where that gives more buckets than the session has shuffle partitions.
BUCKET_ROWS = 4_000_000


def _write_bucketed(df: DataFrame, path: str) -> None:
    """``df`` (one row per ``kmer``) as a bucketed table below ``path``.

    Each write goes to a folder of its own and becomes the table's content with the small file that
    names it, so a write that fails leaves the table as it was. Folders of earlier writes are left
    to whoever still reads them.
    """
    spark = df.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // BUCKET_ROWS + 1)
    name = f"stored_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, "kmer").write.format("parquet").bucketBy(buckets, "kmer").sortBy("kmer")
    writer.option("path", f"{path}/{name}").saveAsTable(name)
    spark.sql(f"drop table {name}")  # the catalog's entry; the files stay
    current = spark.range(1).select(F.lit(name).alias("folder"), F.lit(buckets).alias("buckets"))
    current.coalesce(1).write.mode("overwrite").json(f"{path}/current")


def _read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    current = spark.read.schema("folder string, buckets int").json(f"{path}/current").first()
    folder, name = f"{path}/{current.folder}", f"stored_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema.fields)
    spark.sql(
        f"create table {name} ({columns}) using parquet clustered by (kmer) sorted by (kmer) into {current.buckets} buckets location '{folder}'"
    )
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # resolved above; the files stay
    return table


def _write_params(spark: SparkSession, params: SketchParams, path: str) -> None:
    one = spark.range(1).select(*[F.lit(v).alias(n) for n, v in params.as_dict().items()])
    one.coalesce(1).write.mode("overwrite").json(f"{path}/params")


def _read_params(spark: SparkSession, path: str) -> SketchParams:
    stored = spark.read.schema("k int, w int, seed int").json(f"{path}/params").first()
    return SketchParams(stored.k, stored.w, stored.seed)


def write_reference(index: DataFrame, names: DataFrame, params: SketchParams, path: str) -> None:
    """``index`` as built by the mapping operators, ``names`` with read_id, name and len.

    The k-mers with their copy classes and places are kept beside the occurrences.
    """
    index.write.mode("overwrite").parquet(f"{path}/index")
    _write_bucketed(reference_kmers(index.sparkSession.read.parquet(f"{path}/index")), f"{path}/kmers")
    names.write.mode("overwrite").parquet(f"{path}/names")
    _write_params(index.sparkSession, params, path)


def read_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, SketchParams]:
    return spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/names"), _read_params(spark, path)


def read_reference_kmers(spark: SparkSession, path: str) -> DataFrame:
    """The stored k-mers of a reference, bucketed, for ``mapping.query_seeds(..., kept=True)``."""
    return _read_bucketed(spark, f"{path}/kmers")


def write_readset(readset: Readset, path: str) -> None:
    """Seeds are sorted by k-mer within files, so a later k-mer filter skips row groups."""
    readset.reads.write.mode("overwrite").parquet(f"{path}/reads")
    readset.seeds.sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{path}/seeds")
    _write_bucketed(readset.table, f"{path}/table")
    _write_params(readset.table.sparkSession, readset.params, path)


def read_readset(spark: SparkSession, path: str) -> Readset:
    reads, seeds = (spark.read.parquet(f"{path}/{name}") for name in ("reads", "seeds"))
    return Readset(reads, seeds, _read_bucketed(spark, f"{path}/table"), _read_params(spark, path))
