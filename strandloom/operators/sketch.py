"""Sequence to sampled k-mers (stateless: works on batch and streaming frames)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandloom.functions import kernel
from strandloom.params import SketchParams

_HIT_TYPES = {
    "ord": T.IntegerType(),
    "kmer": T.LongType(),
    "hash": T.LongType(),
    "is_fwd": T.BooleanType(),
    "pos": T.IntegerType(),
    "len": T.LongType(),
}


def _extract(reads, params, seq, keep, emit, extract) -> DataFrame:
    # Only the columns that are used cross into the Arrow batch; the scan prunes the rest.
    narrow = reads.select(*keep, seq)
    fields = [narrow.schema[name] for name in keep]
    fields += [T.StructField(name, _HIT_TYPES[name], False) for name in emit]
    run = kernel.arrow_mapper(extract, seq, list(keep), list(emit), (params.k, params.w, params.factor))
    return narrow.mapInArrow(run, T.StructType(fields))


def sampled_kmers(
    reads: DataFrame,
    params: SketchParams,
    seq: str = "seq",
    keep: Sequence[str] = ("read_id",),
    emit: Sequence[str] = ("ord", "kmer", "is_fwd", "pos"),
) -> DataFrame:
    """Every position whose canonical k-mer hash is 0 modulo ``w``.

    ``ord`` numbers the hits of a read in position order; ``len`` is the number
    of bases. Characters that are not bases are dropped and N is read as A, so
    raw text may be passed directly.
    """
    return _extract(reads, params, seq, keep, emit, kernel.sample_hits)


def jumping_minimizers(
    reads: DataFrame,
    params: SketchParams,
    seq: str = "seq",
    keep: Sequence[str] = ("read_id",),
    emit: Sequence[str] = ("ord", "hash", "is_fwd", "pos"),
) -> DataFrame:
    """Window minima of ``w`` consecutive k-mers, each window starting after the last minimum."""
    return _extract(reads, params, seq, keep, emit, kernel.jumping_minima)
