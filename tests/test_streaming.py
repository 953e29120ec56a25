from pyspark.sql import functions as F

from strandloom.functions import kmers as K
from strandloom.operators import kmerset, sketch
from strandloom.plans import fixtures as fx
from strandloom.streaming import counts

SF = "/root/testdata/sf0.001"


def _folder(spark, tmp_path):
    """The documents as a folder of part files, so that a stream sees several batches."""
    docs = fx.table(spark, SF, "documents")
    for part in range(4):
        docs.where(F.col("doc_id") % 4 == part).coalesce(1).write.parquet(str(tmp_path / "src" / f"documents-{part}"))
    files = sorted((tmp_path / "src").glob("*/part-*.parquet"))
    target = tmp_path / "in" / "documents.parquet"
    target.mkdir(parents=True)
    for i, name in enumerate(files):
        (target / f"part-{i}.parquet").write_bytes(name.read_bytes())
    (target.parent / "documents-old.parquet").write_bytes(files[0].read_bytes())
    return str(target.parent), fx.table(spark, str(target.parent), "documents")


def test_state_outlives_a_restart(spark, tmp_path):
    """New files after a first run are added to the counts that its state holds."""
    folder, every = _folder(spark, tmp_path)
    new = sorted((tmp_path / "in" / "documents.parquet").glob("part-*.parquet"))[-1].read_bytes()
    before = spark.conf.get(next(iter(counts.STATE)), None)

    def run():
        stream = counts.stream_table(spark, folder, "documents").select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq"))
        counts.update_counts(stream, fx.DEFAULT, str(tmp_path / "updates"), str(tmp_path / "c")).awaitTermination()
        return _counts(counts.state_counts(spark, str(tmp_path / "c")))

    def batch():
        docs = fx.table(spark, folder, "documents").select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq"))
        return _counts(kmerset.count_kmers(docs, fx.DEFAULT))

    assert run() == batch()
    (tmp_path / "in" / "documents.parquet" / "part-9.parquet").write_bytes(new)
    spark.catalog.clearCache()
    twice = batch()
    assert run() == twice
    assert spark.conf.get(next(iter(counts.STATE)), None) == before


def _counts(frame):
    return sorted((r.kmer, r.depth) for r in frame.collect())


def test_streams_equal_batch(spark, tmp_path):
    folder, every = _folder(spark, tmp_path)
    batch_reads = every.select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq"))
    want = _counts(kmerset.count_kmers(batch_reads, fx.DEFAULT))

    def stream():
        reads = counts.stream_table(spark, folder, "documents", files_per_batch=1)
        return reads.select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq"))

    for run in range(2):  # a second start finds nothing new and adds nothing
        counts.add_counts(stream(), fx.DEFAULT, str(tmp_path / "parts"), str(tmp_path / "c1"), "a").awaitTermination()
        assert _counts(counts.added_counts(spark, str(tmp_path / "parts"))) == want
    query = counts.update_counts(stream(), fx.DEFAULT, str(tmp_path / "updates"), str(tmp_path / "c2"))
    query.awaitTermination()
    assert len(query.recentProgress) >= 4
    assert _counts(counts.latest_counts(spark, str(tmp_path / "updates"))) == want
    counts.drain_hits(stream(), fx.DEFAULT, str(tmp_path / "hits"), str(tmp_path / "c3")).awaitTermination()
    hits = spark.read.parquet(str(tmp_path / "hits"))
    assert sorted(hits.collect()) == sorted(sketch.sampled_kmers(batch_reads, fx.DEFAULT).collect())
    assert hits.groupBy("kmer").agg(K.saturated(F.count(F.lit(1))).alias("depth")).count() == len(want)
