"""Writers of the text and Parquet forms. All replace what is there, and write in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import dna
from strandmill.sources.readers import NULL, segments


def _text(df: DataFrame, path: str, parts: int = 0) -> None:
    (df.repartition(parts) if parts > 0 else df).write.mode("overwrite").text(path)


def kmer_counts(counted: DataFrame, path: str, k: int, coded: bool = True, codec: str = "none") -> None:
    """Lines "base64 count" by falling count, then k-mer. codec compresses the files (gzip)."""
    key = dna.kmer_base64(dna.from_code(F.col("kmer"), k) if coded else F.col("kmer"))
    counted.orderBy(F.desc("cnt"), "kmer").select(F.concat_ws(" ", key, F.col("cnt").cast("string"))).write.mode("overwrite").option("compression", codec).text(path)


def inverted_index(index: DataFrame, path: str, k: int, coded: bool = True) -> None:
    key = dna.kmer_base64(dna.from_code(F.col("kmer"), k) if coded else F.col("kmer"))
    _text(index.select(F.concat_ws(" ", key, F.array_join(F.col("reads").cast("array<string>"), ","))), path)


def edges(rows: DataFrame, path: str) -> None:
    rows.select("src", "dst", "w").write.mode("overwrite").csv(path)


def clusters(members: DataFrame, path: str, blocks: int = 0) -> int:
    """Lines of sorted, comma-joined ids; returns the number of lines read back."""
    _text(members.select(F.array_join(F.col("members").cast("array<string>"), ",")), path, blocks)
    return members.sparkSession.read.text(path).count()


def labelled_heads(labels: DataFrame, heads: DataFrame, path: str, parts: int = 18) -> None:
    """Lines "head, tab, cluster" of clustered reads with a header."""
    rows = labels.join(heads, "id").select("head", "label")
    rows.coalesce(parts).write.mode("overwrite").option("quote", "").csv(path, sep="\t")


def reads_parquet(rows: DataFrame, path: str, coalesce: bool = False, compat: bool = False) -> None:
    """Typed reads, or with compat the two columns head and id_seq ("id seq"); snappy."""
    out = rows.select(F.coalesce("head", F.lit("")).alias("head"), F.concat_ws(" ", F.col("id").cast("string"), "seq").alias("id_seq")) if compat else rows.select("id", "head", "seq")
    (out.coalesce(1) if coalesce else out).write.mode("overwrite").option("compression", "snappy").parquet(path)


def reads_base64(rows: DataFrame, path: str, coalesce: bool = False) -> None:
    """Lines "id,len packed,len packed"; "id," without a base, "id" alone for a null sequence."""
    out = base64_lines(rows)
    _text(out.coalesce(1) if coalesce else out, path)


def base64_lines(rows: DataFrame) -> DataFrame:
    parts = F.transform(segments(F.col("seq")), lambda s: F.concat_ws(" ", s["len"].cast("string"), s["packed"]))
    return rows.select(F.concat_ws(",", F.col("id").cast("string"), F.array_join(parts, ",")).alias("value"))


def reads_seq(rows: DataFrame, path: str, coalesce: bool = False, codec: str = "none") -> None:
    """Lines "id, tab, head, tab, seq"; an empty field is an empty text, and NULL stands for a null one. codec compresses the files (gzip)."""
    out = rows.select("id", *(F.coalesce(c, F.lit(NULL)).alias(c) for c in ("head", "seq")))
    plain = {"quote": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "compression": codec}
    (out.coalesce(1) if coalesce else out).write.mode("overwrite").options(**plain).csv(path, sep="\t")


def repartitioned(df: DataFrame, path: str, parts: int) -> None:
    """A text table in `parts` files."""
    _text(df, path, parts)


def sequence_store(rows: DataFrame, table: str, buckets: int = 64, compress: bool = True) -> None:
    """Reads as a table bucketed by id, so that joins on ids need no shuffle of the reads."""
    rows.select("id", "seq").write.mode("overwrite").option("compression", "lz4_raw" if compress else "none").bucketBy(buckets, "id").sortBy("id").saveAsTable(table)
