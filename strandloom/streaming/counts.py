"""Sampling and counting reads as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from strandloom.functions import kmers as K
from strandloom.operators.kmerset import count_kmers
from strandloom.operators.sketch import sampled_kmers
from strandloom.params import SketchParams


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A table as a stream with its own schema: the part files of its folder ``name.parquet``, or the single file of that name."""
    path = f"{folder}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drain_hits(reads: DataFrame, params: SketchParams, path: str, checkpoint: str) -> StreamingQuery:
    """Append the sampled k-mers of all available reads (stateless, exactly once)."""
    hits = sampled_kmers(reads, params)
    writer = hits.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def add_counts(reads: DataFrame, params: SketchParams, path: str, checkpoint: str, source: str) -> StreamingQuery:
    """Count each micro-batch into its own partial table.

    A batch that is retried overwrites its folder, so nothing is counted twice;
    no state is kept between batches, and several sources may add to one path.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        count_kmers(batch, params).write.mode("overwrite").parquet(f"{path}/source={source}/epoch={epoch}")

    writer = reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def added_counts(spark: SparkSession, path: str) -> DataFrame:
    """All partial tables merged."""
    parts = spark.read.parquet(path)
    return parts.groupBy("kmer").agg(K.saturated(F.sum("depth")).alias("depth")).withColumn("info", F.lit(0))


# The state lives on the executors' disks, not in the JVM heap, and batches upload only what they changed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _start_with_state(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Start with the settings of ``STATE``; a query keeps those it is started with, the session gets its own back."""
    before = {name: spark.conf.get(name, None) for name in STATE}
    try:
        for name, value in STATE.items():
            spark.conf.set(name, value)
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def update_counts(reads: DataFrame, params: SketchParams, path: str, checkpoint: str) -> StreamingQuery:
    """Keyed running counts in the state store; each batch writes the k-mers it changed.

    A restart goes on from ``checkpoint``. The totals are those of ``state_counts``, whatever the number
    of batches; the folders of ``path`` are for those who follow the changes.
    """
    counts = sampled_kmers(reads, params, keep=(), emit=("kmer",)).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return _start_with_state(reads.sparkSession, writer.trigger(availableNow=True))


def state_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All k-mers with their depths, read from the state of ``update_counts`` after its last batch."""
    state = spark.read.format("statestore").load(checkpoint)
    kmer, n = (state.schema[part].dataType.fieldNames()[0] for part in ("key", "value"))
    return state.select(F.col("key")[kmer].alias("kmer"), K.saturated(F.col("value")[n]).alias("depth"))


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """Last written count of each k-mer."""
    updates = spark.read.parquet(path)
    latest = updates.groupBy("kmer").agg(F.max_by("n", "epoch").alias("n"))
    return latest.select("kmer", K.saturated(F.col("n")).alias("depth"))
