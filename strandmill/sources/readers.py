"""Readers: text and Parquet forms to typed tables, by Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions import dna
from strandmill.operators.state import written

SEQ_SCHEMA = "id long, head string, seq string"
#: What stands for a null header or sequence in seq files; an empty field is an empty one.
NULL = "\\N"


def reads(spark: SparkSession, path: str | list[str], form: str = "seq", pattern: str = "", partitions: int = 0, fraction: float = -1.0, seed: int = 0) -> DataFrame:
    """(id, head, seq) from seq (tab-separated), base64 or parquet files; base64 has no headers.

    pattern filters file names; fraction > 0 samples rows without replacement; partitions > 0 deals them out anew. A line of a seq
    file that is no read (its id no number, or other than three fields) is an error.
    """
    source = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    if form == "seq":
        rows = source.schema(SEQ_SCHEMA).option("quote", "").option("mode", "FAILFAST").csv(path, sep="\t")
        rows = rows.select("id", *(F.when(F.col(c) == NULL, F.lit(None)).otherwise(F.coalesce(c, F.lit(""))).alias(c) for c in ("head", "seq")))
    elif form == "base64":
        rows = base64_reads(source.text(path))
    elif form == "parquet":
        rows = source.parquet(path)
        if "id_seq" in rows.columns:
            rows = rows.select(F.split_part("id_seq", F.lit(" "), F.lit(1)).cast("long").alias("id"), "head", F.split_part("id_seq", F.lit(" "), F.lit(2)).alias("seq"))
        rows = rows.select("id", "head", "seq")
    else:
        raise ValueError(f"format: {form}")
    rows = rows.withColumn("seq", dna.clean(F.col("seq")))
    if fraction > 0:
        rows = rows.sample(False, fraction, seed)
    return rows.repartition(partitions) if partitions > 0 else rows


def segments(seq: Column) -> Column:
    """The sequence's parts between N as an array of (len, packed), empty ones left out. Packed is one line of base64, however long."""
    parts = F.filter(F.split(seq, "N"), lambda p: F.length(p) > 0)
    return F.transform(parts, lambda p: F.struct(F.length(p).alias("len"), F.translate(F.base64(dna.pack(p)), "\r\n", "").alias("packed")))


def joined(segs: Column) -> Column:
    """The sequence of segments, with one N between two."""
    return F.array_join(F.transform(segs, lambda s: dna.unpack(F.unbase64(s["packed"]), s["len"])), "N")


def base64_reads(lines: DataFrame) -> DataFrame:
    """(id, head, seq) from lines "id,len packed,len packed". "id," is a sequence without a base, "id" alone a null one."""
    fields = F.split("value", ",")
    held = F.filter(F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))), lambda p: p != "")
    parts = F.transform(held, lambda p: F.struct(F.split_part(p, F.lit(" "), F.lit(1)).cast("int").alias("len"), F.split_part(p, F.lit(" "), F.lit(2)).alias("packed")))
    return lines.where("value <> ''").select(F.get(fields, 0).cast("long").alias("id"), F.lit(None).cast("string").alias("head"), F.when(F.size(fields) > 1, joined(parts)).alias("seq"))


def headers(spark: SparkSession, path: str, form: str = "seq", pattern: str = "") -> DataFrame:
    """(id, head) of reads; base64 files have none."""
    if form == "base64":
        raise ValueError("base64 reads have no headers")
    return reads(spark, path, form, pattern).select("id", "head")


def kmer_counts(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """(kmer, cnt) from lines "base64 count"; kmer is the base64 form, or bases where k is given."""
    rows = spark.read.text(path).where("value <> ''")
    key = F.split_part("value", F.lit(" "), F.lit(1))
    return rows.select((dna.base64_kmer(key, k) if k else key).alias("kmer"), F.split_part("value", F.lit(" "), F.lit(2)).cast("long").alias("cnt"))


def inverted_index(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, reads) from lines "base64 id,id"."""
    rows = spark.read.text(path).where("value <> ''")
    return rows.select(F.split_part("value", F.lit(" "), F.lit(1)).alias("kmer"), F.split(F.split_part("value", F.lit(" "), F.lit(2)), ",").cast("array<long>").alias("reads"))


def edges(spark: SparkSession, path: str, least: int = 2, most: int = 20000, partitions: int = 0) -> DataFrame:
    """(src, dst, w) from lines "a,b,w" with least <= w <= most; the filter runs in the scan."""
    rows = spark.read.schema("src long, dst long, w long").csv(path).where(F.col("w").between(least, most))
    return rows.repartition(partitions) if partitions > 0 else rows


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) from lines of comma-joined ids; the label is the line's smallest id."""
    ids = spark.read.text(path).where("value <> ''").select(F.split("value", ",").cast("array<long>").alias("ids"))
    return ids.select(F.array_min("ids").alias("label"), F.explode("ids").alias("id")).select("id", "label")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(head, truth) from tab-separated lines."""
    return spark.read.schema("head string, truth string").csv(path, sep="\t")


def positions(rows: DataFrame, out: str, start: int = 0) -> DataFrame:
    """Rows with contiguous numbers from `start` in column `out`, in partition order: places in partitions plus prefix sums of their sizes.

    Rows are made once and written with their places; one row for each partition is summed.
    """
    spot = F.monotonically_increasing_id()
    placed = written(rows.select("*", F.shiftright(spot, 33).alias("_part"), spot.bitwiseAND(F.lit(2**33 - 1)).alias("_at")), "positions")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return placed.join(base, "_part").select((F.col("_base") + F.col("_at") + start).alias(out), *rows.columns)


def numbered(lines: DataFrame) -> DataFrame:
    """Lines (value) with contiguous 0-based numbers in partition order, which for text files is file and offset."""
    return positions(lines.select("value"), "n")


def fasta(lines: DataFrame, paired: bool = False) -> DataFrame:
    """(n, head, seq) from single-line FASTA lines; paired joins two records by N under the first's header."""
    rows = numbered(lines).withColumn("rec", F.expr("n div 2"))
    recs = rows.groupBy("rec").agg(F.max(F.when(F.col("n") % 2 == 0, F.regexp_replace("value", "^>", ""))).alias("head"), F.max(F.when(F.col("n") % 2 == 1, F.upper("value"))).alias("seq"))
    return _joined_pairs(recs) if paired else recs.withColumnRenamed("rec", "n")


def fastq(lines: DataFrame, paired: bool = False) -> DataFrame:
    """(n, head, seq) from four-line FASTQ records; paired joins two records by N under the first's header."""
    rows = numbered(lines).withColumn("rec", F.expr("n div 4"))
    recs = rows.groupBy("rec").agg(F.max(F.when(F.col("n") % 4 == 0, F.regexp_replace("value", "^@", ""))).alias("head"), F.max(F.when(F.col("n") % 4 == 1, F.upper("value"))).alias("seq"))
    return _joined_pairs(recs) if paired else recs.withColumnRenamed("rec", "n")


def _joined_pairs(recs: DataFrame) -> DataFrame:
    two = recs.groupBy(F.expr("rec div 2").alias("n")).agg(F.min_by("head", "rec").alias("head"), F.sort_array(F.collect_list(F.struct("rec", "seq"))).alias("p"))
    return two.select("n", "head", F.array_join(F.transform("p", lambda s: s["seq"]), "N").alias("seq"))


def interleaved(first: DataFrame, second: DataFrame) -> DataFrame:
    """FASTA lines (n, value) of two FASTQ files in lockstep: header and sequence of the first's record, then of the second's."""
    a, b = fastq(first), fastq(second)
    rows = a.select((F.col("n") * 2).alias("n"), "head", "seq").unionByName(b.select((F.col("n") * 2 + 1).alias("n"), "head", "seq"))
    return rows.select("n", F.concat(F.lit(">"), "head", F.lit("\n"), "seq").alias("value")).orderBy("n")


def with_ids(rows: DataFrame, start: int = 0) -> DataFrame:
    """Rows (head, seq) with contiguous ids from `start`, in partition order."""
    return positions(rows.select("head", "seq"), "id", start)


def shuffled_ids(rows: DataFrame, seed: int, order: str = "head") -> DataFrame:
    """Rows with ids by a seeded hash order of `order`: a random but repeatable deal."""
    return positions(rows.orderBy(F.xxhash64(F.lit(seed), order), order), "id").select(*rows.columns, "id")
