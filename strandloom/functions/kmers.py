"""k-mer integers as column expressions: code, decode, hash, canonical strand, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.sequences import reverse_complement
from strandloom.params import SketchParams

# A k-mer's info bits. The low two bits hold the copy class.
COPY_MASK = 3
COPY_MANY = 3
MINOR = 4
REPEAT = 8
INTERNAL = 16
MARKED = 32  # occurs in, or is placed against, the repeat reference
INFO_BYTE = 255
MAX_DEPTH = 65535  # counts saturate here


def encode(text: Column) -> Column:
    """Text of up to 31 bases to its 2-bit code (A0 C1 G2 T3, anything else 0)."""
    digits = F.regexp_replace(F.translate(F.upper(text), "ACGT", "0123"), "[^0-3]", "0")
    return F.conv(digits, 4, 10).cast("bigint")


def decode(kmer: Column, k: int) -> Column:
    """2-bit code to lower-case text."""
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", "acgt")


def hash_code(kmer: Column, params: SketchParams) -> Column:
    """``(kmer * factor mod 2^64) >> (64-2k)`` in exact decimals, valid in ANSI mode."""
    precision = 18 if params.k <= 29 else 19
    product = kmer.cast(f"decimal({precision},0)") * F.lit(str(params.factor)).cast("decimal(19,0)")
    wrapped = product % F.lit(str(2**64)).cast("decimal(20,0)")
    return F.call_function("div", wrapped, F.lit(str(2**params.shift)).cast("decimal(20,0)"))


def canonical_parts(text: Column, params: SketchParams) -> dict[str, Column]:
    """Codes and hashes of a k-base text and of its reverse complement."""
    forward, reverse = encode(text), encode(reverse_complement(text))
    return {
        "kmer_f": forward,
        "kmer_r": reverse,
        "hash_f": hash_code(forward, params),
        "hash_r": hash_code(reverse, params),
    }


def copy_class(info: Column) -> Column:
    return info.bitwiseAND(F.lit(COPY_MASK))


def with_copy(info: Column, copy: Column | int) -> Column:
    """Replace the copy class, keep the other bits."""
    value = F.lit(copy) if isinstance(copy, int) else copy
    return info.bitwiseAND(F.lit(INFO_BYTE & ~COPY_MASK)).bitwiseOR(value)


def with_flag(info: Column, flag: int, condition: Column) -> Column:
    return F.when(condition, info.bitwiseOR(F.lit(flag))).otherwise(info)


def has_flag(info: Column, flag: int) -> Column:
    return info.bitwiseAND(F.lit(flag)) != 0


def saturated(count: Column) -> Column:
    return F.least(count, F.lit(MAX_DEPTH)).cast("int")
