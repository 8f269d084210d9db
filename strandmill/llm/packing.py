"""Packing by concatenate and cut.

All documents' ids stand in one line, in the order of input partitions and of rows in them. Pass 1 encodes each
partition once, writes ids with their offsets inside the partition, and yields each partition's token total.
Exclusive prefix sums over those totals give global offsets. Pass 2 cuts the line at multiples of the sequence
length; every cut document leaves one boundary record for each window that it touches. No row is shuffled: only
one total for each partition moves. All sequences but the last are full.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import common
from strandmill.llm.tokens import encoder


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(part, local_start, doc_id, doc_tokens, ids) of each row; ids are little-endian unsigned 32-bit with end_id last."""
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 512):
                ids = [x + end for x in enc.batch(texts[lo : lo + 512])]
                sizes, starts = [len(x) // 4 for x in ids], []
                for n in sizes:
                    starts.append(at)
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), keys[lo : lo + 512], pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    names=["part", "local_start", "doc_id", "doc_tokens", "ids"],
                )
        enc.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(common.arrow_map, encode, "part int, local_start long, doc_id long, doc_tokens long, ids binary")


def pack(docs: DataFrame, path: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """One row for each piece: doc_id, start (in its document), length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Null text is empty: such a document is its end id alone. Null doc_ids and repeated rows stay rows of their own.
    An empty table gives no pieces. Columns other than doc_id and text are not read.
    """
    ids = common.staged(tokenized(docs, path, end_id), "packing")
    totals = ids.groupBy("part").agg(F.max(F.col("local_start") + F.col("doc_tokens")).alias("total"))
    base = common.small(common.bases(totals, "part", "total", "base"))
    at = F.col("base") + F.col("local_start")
    cut = (
        ids.join(base, "part")
        .withColumn("at", at)
        .withColumn("sequence_id", F.explode(F.sequence(F.expr(f"at div {length}"), F.expr(f"(at + doc_tokens - 1) div {length}"))))
        .withColumn("start", F.greatest(F.lit(0), F.col("sequence_id") * length - F.col("at")))
        .withColumn("length", F.least(F.col("doc_tokens"), (F.col("sequence_id") + 1) * length - F.col("at")) - F.col("start"))
        .withColumn("ids", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))"))
    )
    return cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", (F.col("at") + F.col("start") - F.col("sequence_id") * length).alias("offset"), "ids")
