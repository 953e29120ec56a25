"""Queries over the shared tables."""

from strandloom.plans import format_queries, kmer_queries, linkage_queries, mapping_queries, readset_queries, repeat_queries, sequence_queries, streaming_queries  # noqa: F401
from strandloom.plans.registry import ORACLES, QUERIES  # noqa: F401
