"""What the training-data operators share: staging folders, prefix sums and guarded broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of at most about 100 bytes that a broadcast may hold; larger sides are shuffled.
BROADCAST_ROWS = 500_000
#: Bytes of an Arrow batch on its way to a Python worker. Both sides of the pipe hold a batch for each running task.
BATCH_BYTES = 8 << 20
#: White space of the word contracts: space, tab, LF, VT, FF, CR.
WORD = "[^\\x20\\x09-\\x0D]+"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is not set, a folder of this machine if the master is local, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staging(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder. Results may read from it, so it goes with the shared folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = staging(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow with batches of about BATCH_BYTES at most (a longer row is a batch of its own), for long texts.

    The session's spark.sql.execution.arrow.maxBytesPerBatch is lowered to that where it is larger, and stays so. Workers live on
    after a task, so they give what the task's tables held back to the system at its end.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(conf.get(name).lower().rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory of this process to the system, as far as its allocators allow it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else as it is, for a shuffled join. df should be cheap to count."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def bases(totals: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Exclusive prefix sums of `value` in order of `key`, for a table with one row for each task or bucket."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long").alias(out))


def fold(doc_id: int | None, parts: int) -> int:
    """crc32 of the id as text, modulo parts; -1 for a null id."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % parts


def fold_column(doc_id: Column, parts: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply) over uint64 arrays."""
    x = x.copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
