"""The shared tables consumed as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.plans import fixtures as fx
from strandloom.plans import sql
from strandloom.plans.kmer_queries import COUNTS, HITS
from strandloom.plans.registry import query
from strandloom.sources.lines import scratch_path
from strandloom.streaming import counts


def _reads(spark, sf_dir, name, read_id, text):
    stream = counts.stream_table(spark, sf_dir, name)
    return stream.select(read_id.alias("read_id"), F.col(text).alias("seq"))


@query("stream_sampled_kmers", f"{HITS} select read_id, ord, kmer, is_fwd, pos from h")
def stream_sampled_kmers(spark, sf_dir):
    root = scratch_path(spark, "stream-hits")
    reads = _reads(spark, sf_dir, "documents", F.col("doc_id"), "text")
    counts.drain_hits(reads, fx.DEFAULT, f"{root}/hits", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/hits")


@query(
    "incremental_count_equals_batch",
    f"""with {sql.hits('a', sql.DOCUMENTS, fx.DEFAULT)}, {sql.hits('b', sql.CONVERSATIONS, fx.DEFAULT)},
u as (select kmer from a union all select kmer from b) select kmer, least(count(*),65535)::integer as depth from u group by kmer""",
)
def incremental_count_equals_batch(spark, sf_dir):
    """Two streams added into one set of partial tables."""
    root = scratch_path(spark, "stream-counts")
    documents = _reads(spark, sf_dir, "documents", F.col("doc_id"), "text")
    turns = _reads(spark, sf_dir, "conversations", F.col("conv_id") * 1000 + F.col("turn"), "text")
    for name, reads in (("documents", documents), ("conversations", turns)):
        counts.add_counts(reads, fx.DEFAULT, f"{root}/parts", f"{root}/checkpoint-{name}", name).awaitTermination()
    return counts.added_counts(spark, f"{root}/parts").select("kmer", "depth")


@query("stream_state_counts", f"{COUNTS} select kmer, depth from t")
def stream_state_counts(spark, sf_dir):
    root = scratch_path(spark, "stream-state")
    reads = _reads(spark, sf_dir, "documents", F.col("doc_id"), "text")
    counts.update_counts(reads, fx.DEFAULT, f"{root}/updates", f"{root}/checkpoint").awaitTermination()
    return counts.state_counts(spark, f"{root}/checkpoint")
