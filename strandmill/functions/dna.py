"""DNA strings, k-mers and packed forms as column expressions: no UDF, nothing leaves the JVM.

Bases are upper case A, C, G, T; N splits a sequence. Packed forms number bases A=0, T=1, C=2, G=3, four to a byte, first base
in the high bits, zero filled. Canonical means the smaller of a k-mer and its reverse complement as strings.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed order of base numbers in packed forms.
BASES = "ATCG"
PIECE = 256


def clean(seq: Column) -> Column:
    """Upper case, with everything but A, C, G, T turned into N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def _pieces(seq: Column, k: int) -> Column:
    """Pieces of a sequence, none with an N, that overlap by k - 1 bases, so that each k-mer lies in one."""
    parts = F.filter(F.split(seq, "N"), lambda p: F.length(p) >= k)
    # Taking a substring walks from the start of its string: long parts are cut in overlapping pieces first.
    return F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - (k - 1), F.lit(PIECE)), lambda i: F.substr(p, i, F.lit(PIECE + k - 1)))))


def windows(seq: Column, k: int) -> Column:
    """All k-mers of a sequence, in order, none across an N."""
    return F.flatten(F.transform(_pieces(seq, k), lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - (k - 1)), lambda i: F.substr(p, i, F.lit(k)))))


def canonical_windows(seq: Column, k: int) -> Column:
    """The canonical forms of all k-mers: each piece is complemented once, not each k-mer."""
    both = F.transform(_pieces(seq, k), lambda p: F.struct(p.alias("p"), reverse_complement(p).alias("r"), (F.length(p) - (k - 1)).alias("n")))
    return F.flatten(F.transform(both, lambda s: F.transform(F.sequence(F.lit(1), s["n"]), lambda i: F.least(F.substr(s["p"], i, F.lit(k)), F.substr(s["r"], s["n"] + 1 - i, F.lit(k))))))


def kmers(seq: Column, k: int, strands: str = "canonical", prefix: str = "") -> Column:
    """Distinct k-mers of a sequence: strands is "canonical", "both" or "forward"; a prefix keeps k-mers that start with it."""
    own = canonical_windows(seq, k) if strands == "canonical" else windows(seq, k)
    if strands == "both":
        own = F.concat(own, F.transform(own, reverse_complement))
    elif strands not in ("canonical", "forward"):
        raise ValueError(f"strands: {strands}")
    if prefix:
        own = F.filter(own, lambda x: x.startswith(prefix))
    return F.array_distinct(own)


def _digits(kmer: Column) -> Column:
    return F.translate(kmer, BASES, "0123")


def code(kmer: Column) -> Column:
    """A k-mer of up to 31 bases as a BIGINT, two bits a base."""
    return F.conv(_digits(kmer), 4, 10).cast("long")


def from_code(value: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 4), k, "0"), "0123", BASES)


def pack(seq: Column) -> Column:
    """Packed bytes of a sequence of any length over A, C, G, T."""
    padded = F.rpad(_digits(seq), F.ceil(F.length(seq) / 4).cast("int") * 4, "0")
    hexed = F.transform(F.regexp_extract_all(padded, F.lit("(..)"), F.lit(1)), lambda two: F.conv(two, 4, 16))
    return F.unhex(F.array_join(hexed, ""))


def unpack(packed: Column, length: Column) -> Column:
    """The first `length` bases of packed bytes."""
    pairs = F.transform(F.regexp_extract_all(F.hex(packed), F.lit("(.)"), F.lit(1)), lambda h: F.lpad(F.conv(h, 16, 4), 2, "0"))
    return F.translate(F.substr(F.array_join(pairs, ""), F.lit(1), length), "0123", BASES)


def kmer_base64(kmer: Column) -> Column:
    """Base64 of the packed bytes of a k-mer of up to 32 bases, eight bytes wide."""
    return F.base64(F.unhex(F.lpad(F.conv(F.rpad(_digits(kmer), 32, "0"), 4, 16), 16, "0")))


def base64_kmer(text: Column, k: int) -> Column:
    return unpack(F.unbase64(text), F.lit(k))


def long_base64(value: Column) -> Column:
    """Base64 of a BIGINT's eight big-endian bytes."""
    return F.base64(F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0")))


def base64_long(text: Column) -> Column:
    """The BIGINT in eight big-endian bytes."""
    unsigned = F.conv(F.hex(F.unbase64(text)), 16, 10).cast("decimal(20,0)")
    half, full = F.lit("9223372036854775808").cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.when(unsigned >= half, unsigned - full).otherwise(unsigned).cast("long")


def int_base64(value: Column) -> Column:
    """Base64 of an INT's four big-endian bytes."""
    return F.base64(F.unhex(F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(8))))


def unsigned_byte(value: Column) -> Column:
    """0 to 255 for a signed byte."""
    return F.pmod(value.cast("int"), F.lit(256))


def pos_mod(value: Column, n: int) -> Column:
    return F.pmod(value, F.lit(n))


def prefix_groups(width: int) -> list[str]:
    """All prefixes of `width` bases (1 to 4: groups of 4, 16, 64, 256)."""
    return ["".join(p) for p in product(BASES, repeat=width)]


def argsort(values: Column, descending: bool = False) -> Column:
    """0-based positions of an array's elements in stable ascending (or descending) order."""
    pairs = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    sign = -1 if descending else 1

    def compare(a: Column, b: Column) -> Column:
        return F.when(a["v"] < b["v"], -sign).when(a["v"] > b["v"], sign).otherwise(a["i"] - b["i"])

    return F.transform(F.array_sort(pairs, compare), lambda p: p["i"])


def reindex(values: Column, index: Column) -> Column:
    """values gathered at 0-based positions."""
    return F.transform(index, lambda i: F.element_at(values, i + 1))


def median_of(values: Column) -> Column:
    """Median of an array, the mean of the middle two for even sizes; null if empty."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)


def overlap_weight(weight: Column, mode: str) -> Column:
    """Edge weight by mode: none is 1, edge is the count, logedge its natural logarithm."""
    if mode not in ("none", "edge", "logedge"):
        raise ValueError(f"weight: {mode}")
    return F.lit(1.0) if mode == "none" else weight.cast("double") if mode == "edge" else F.log(weight.cast("double"))
