"""K-mer features of reads (id, seq): long form, counts, most frequent share, inverted index.

The long form (kmer, id) holds each k-mer of a read once. For k up to 31 a numpy kernel over Arrow batches makes BIGINT codes
(two bits a base, see functions.dna.code); the expression path gives the same rows as strings for any k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions import dna
from strandmill.sources.readers import positions

#: Number of a base in string order (A, C, G, T), 4 for anything else.
_ALPHA = np.full(256, 4, dtype=np.int64)
for _i, _c in enumerate(b"ACGT"):
    _ALPHA[_c] = _i
#: From string order to packed numbers: A=0, T=1, C=2, G=3.
_PACK = np.array([0, 2, 3, 1, 0], dtype=np.int64)


def _rolled(numbers: np.ndarray, k: int, up: bool) -> np.ndarray:
    """Codes of all windows of k two-bit numbers, by doubling widths; up=True gives the first number the high bits."""
    done, width, place = None, 0, 0
    part, size = numbers, 1
    n = len(numbers) - k + 1
    bits = [b for b in range(k.bit_length()) if k >> b & 1]
    for b in range(k.bit_length()):
        if b in bits:
            piece = part[place : place + n]
            if done is None:
                done, width = piece.copy(), size
            else:
                done = (done << 2 * size) | piece if up else done | piece << 2 * width
                width += size
            place += size
        if b < k.bit_length() - 1:
            part = (part[:-size] << 2 * size) | part[size:] if up else part[:-size] | part[size:] << 2 * size
            size *= 2
    return done


def codes(seq: bytes, k: int, strands: str = "canonical") -> np.ndarray:
    """Distinct packed codes of a read's k-mers, k up to 31."""
    x = _ALPHA[np.frombuffer(seq, dtype=np.uint8)]
    if len(x) < k:
        return np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(x == 4)])
    ok = bad[k:] == bad[:-k]
    other = np.where(x == 4, 4, 3 - x)
    fine = lambda y, up: _rolled(np.where(y == 4, 0, y), k, up)[ok]
    packed = lambda y, up: _rolled(_PACK[y], k, up)[ok]
    if strands == "forward":
        out = packed(x, True)
    elif strands == "both":
        out = np.concatenate([packed(x, True), packed(other, False)])
    else:
        out = np.where(fine(x, True) <= fine(other, False), packed(x, True), packed(other, False))
    return np.unique(out)


def explode(reads: DataFrame, k: int, strands: str = "canonical", impl: str = "arrow", prefix: str = "") -> DataFrame:
    """(kmer, id): each distinct k-mer of each read. kmer is a BIGINT code (arrow, k <= 31) or a string (expr)."""
    if impl == "expr" or prefix:
        return reads.select(F.explode(dna.kmers(F.col("seq"), k, strands, prefix)).alias("kmer"), "id")
    if k > 31:
        raise ValueError("codes hold up to 31 bases; use impl='expr'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                ids = batch.column(0)[lo : lo + 64].to_numpy(zero_copy_only=False)
                got = [codes((s.as_py() or "").encode(), k, strands) for s in batch.column(1)[lo : lo + 64]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got), pa.int64()), pa.array(np.repeat(ids, [len(g) for g in got]), pa.int64())], names=["kmer", "id"])

    return reads.where("id is not null").select(F.col("id").cast("long"), F.col("seq").cast("string")).mapInArrow(run, "kmer long, id long")


def residue(features: DataFrame, n: int, i: int) -> DataFrame:
    """The share of k-mers of pass i of n."""
    return features.where(F.pmod(F.xxhash64("kmer"), F.lit(n)) == i)


def counts(features: DataFrame, least: int = 2) -> DataFrame:
    """(kmer, cnt): in how many reads each k-mer is, of those in `least` or more. Partial counts run before the shuffle."""
    return features.groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= least)


def ranked(counted: DataFrame) -> DataFrame:
    """By falling count, then k-mer."""
    return counted.orderBy(F.desc("cnt"), "kmer")


def top_fraction(counted: DataFrame, fraction: float, exact: bool = False) -> DataFrame:
    """The most frequent k-mers: the first floor(n * fraction) + 1 by falling count, then k-mer (exact: without the one more).

    The cut count comes from a histogram of counts; only k-mers tied at the cut are sorted and numbered, over all tasks. A fraction of 0 gives none.
    """
    if fraction <= 0:
        return counted.limit(0)
    histogram = counted.groupBy("cnt").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("cnt"))
    steps = histogram.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    want = F.floor(F.col("all") * F.lit(fraction)) + (0 if exact else 1)
    cut = steps.where((F.col("upto") >= want) & (F.col("upto") - F.col("n") < want)).select("cnt", (want - F.col("upto") + F.col("n")).alias("rest")).first()
    if cut is None:
        return counted if not exact else counted.limit(0)
    tied = positions(counted.where(F.col("cnt") == cut.cnt).orderBy("kmer"), "_n").where(F.col("_n") < cut.rest).drop("_n")
    return counted.where(F.col("cnt") > cut.cnt).unionByName(tied.select(*counted.columns))


def without(features: DataFrame, dropped: DataFrame) -> DataFrame:
    """Features whose k-mer is not among the dropped."""
    return features.join(dropped.select("kmer"), "kmer", "left_anti")


def capped(features: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most `most` reads of each k-mer, the first by a seeded hash; the limit is applied before the shuffle as well."""
    w = Window.partitionBy("kmer").orderBy(F.xxhash64(F.lit(seed), "id", "kmer"), "id")
    return features.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def in_range(features: DataFrame, least: int) -> DataFrame:
    """Features whose k-mer is in `least` or more reads."""
    often = features.groupBy("kmer").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("kmer")
    return features.join(often, "kmer", "left_semi")


def inverted_index(features: DataFrame, least: int = 2, most: int = 200, contaminants: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(kmer, reads): sorted reads of each k-mer in `least` or more reads, at most `most` of them, without contaminants."""
    if contaminants is not None:
        features = without(features, contaminants)
    kept = capped(features, most, seed)
    index = kept.groupBy("kmer").agg(F.array_sort(F.collect_list("id")).alias("reads"))
    return index.where(F.size("reads") >= least)


def label(kmer: Column, k: int, coded: bool = True) -> Column:
    """The k-mer as a string."""
    return dna.from_code(kmer, k) if coded else kmer
