"""Column expressions on sequences, qualities and integer lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabets of the accepted inputs and what each letter becomes.
# A letter that is not listed is rejected. Lower case is folded except for "text" and "letters".
ALPHABETS: dict[str, dict[str, str]] = {
    "text": {"from": "ACGTNacgtn", "to": "ACGTNacgtn"},
    "letters": {"from": "ABCDGHKMNRSTVWYabcdghkmnrstvwy-", "to": "ABCDGHKMNRSTVWYabcdghkmnrstvwy-"},
    "iupac": {"from": "ABCDGHKMNRSTVWY-", "to": "ABCDGHKMNRSTVWY-"},
    "iupac_to_n": {"from": "ABCDGHKMNRSTVWY", "to": "ANCNGNNNNNNTNNN"},
    "protein": {"from": "ABCDEFGHIKLMNPQRSTVWXYZ", "to": "AXCDEFGHIKLMNPQRSTVWXYX"},
}
# Numeric codes. "index" keeps N apart, "index4" reads it as A; the
# "mask" codes set one bit per possible base.
INDEX = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 4}
INDEX4 = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 0}
MASK = {"A": 1, "C": 2, "G": 4, "T": 8, "N": 15}
IUPAC_MASK = {
    "-": 0, "A": 1, "C": 2, "M": 3, "G": 4, "R": 5, "S": 6, "V": 7,
    "T": 8, "W": 9, "H": 11, "K": 12, "D": 13, "B": 14, "N": 15,
}
PROTEIN_LETTERS = "ACDEFGHIKLMNPQRSTVWYX"
# IUPAC letters and their complements, and bases with theirs.
IUPAC, IUPAC_COMPLEMENT = "ABCDGHKMNRSTVWY", "TVGHCDMKNYSABWR"
BASES, BASE_COMPLEMENT = "ACGTacgt", "TGCAtgca"


def _ascii_upper(seq: Column) -> Column:
    return F.translate(seq, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def convert_alphabet(seq: Column, alphabet: str) -> Column:
    """Rewrite letters by an ALPHABETS table and drop rejected characters."""
    table = ALPHABETS[alphabet]
    folded = seq if alphabet in ("text", "letters") else _ascii_upper(seq)
    kept = F.regexp_replace(folded, f"[^{table['from']}]+", "")
    return kept if table["from"] == table["to"] else F.translate(kept, table["from"], table["to"])


def letter_codes(seq: Column, codes: dict[str, int]) -> Column:
    """Array of numeric codes of the accepted letters."""
    letters = "".join(codes)
    kept = F.regexp_replace(_ascii_upper(seq), f"[^{letters}]+", "")
    lookup = F.create_map(*[F.lit(item) for pair in codes.items() for item in pair])
    return F.transform(F.filter(F.split(kept, ""), lambda c: c != ""), lambda c: lookup[c])


def protein_codes() -> dict[str, int]:
    """Position in PROTEIN_LETTERS; ambiguous letters share the code of X."""
    table = ALPHABETS["protein"]
    return {given: PROTEIN_LETTERS.index(letter) for given, letter in zip(table["from"], table["to"])}


def bases(text: Column) -> Column:
    """Upper-case bases and N of any text; everything else is dropped."""
    return F.translate(F.regexp_replace(text, "[^ACGTNacgtn]+", ""), "acgtn", "ACGTN")


def unknown_as_a(seq: Column) -> Column:
    return F.translate(seq, "Nn", "Aa")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, BASE_COMPLEMENT))


def complement_iupac(seq: Column) -> Column:
    return F.translate(seq, IUPAC + IUPAC.lower(), IUPAC_COMPLEMENT + IUPAC_COMPLEMENT.lower())


def compress_homopolymers(seq: Column) -> Column:
    """Keep the first letter of each run, comparing without case."""
    return F.regexp_replace(seq, r"(?i)(.)\1+", "$1")


def trim_linked_read(seq: Column, ordinal: Column, n: int = 23) -> Column:
    """Skip the first ``n`` bases of the 1st, 3rd, 5th ... sequence (``ordinal`` from 1)."""
    return F.when(ordinal % 2 == 1, F.substring(seq, n + 1, 2**31 - 1)).otherwise(seq)


def quality_values(text: Column) -> Column:
    """Quality string to integers (offset 33)."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def quality_text(values: Column, n: Column) -> Column:
    """Integers to a quality string; a missing quality becomes ``n`` times '!'."""
    written = F.array_join(F.transform(values, lambda q: F.char(q + 33)), "")
    return F.coalesce(written, F.repeat(F.lit("!"), n.cast("int")))


def quality_bits(values: Column, threshold: int) -> Column:
    return F.transform(values, lambda q: q >= threshold)


def deltas(values: Column) -> Column:
    """First element, then differences of neighbours."""
    before = F.concat(F.array(F.lit(0).cast("bigint")), values)
    return F.transform(values, lambda v, i: v - F.get(before, i))


def running_totals(values: Column) -> Column:
    """Inverse of ``deltas``."""

    def extend(sums: Column, v: Column) -> Column:
        last = F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0))
        return F.array_append(sums, last + v)

    return F.aggregate(values, F.array().cast("array<bigint>"), extend)


def length_bin(length: Column) -> Column:
    """Quadratic length bin; bin ``i`` starts at ``i*i/100``."""
    return F.floor(10 * F.sqrt(length.cast("double"))).cast("int")


def ratio(part: Column, whole: Column) -> Column:
    """Double division, NULL for an empty denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """``part*100/whole`` as a double, NULL for an empty denominator."""
    return F.try_divide(part * F.lit(100.0), whole.cast("double"))
