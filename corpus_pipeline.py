"""From raw documents to packed training sequences: the stages in order, and all of them as one query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import documents, scratch
from strandloom.llm.exact_dedup import exact_dedup_stage
from strandloom.llm.mixing import mixing_stage
from strandloom.llm.packing import packing_stage
from strandloom.llm.simhash import near_dedup_stage
from strandloom.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# A trained network and rounded rates are not SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written as Parquet and read again by the next one."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return docs
