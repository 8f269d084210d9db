"""Iterative state in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is not set, a folder of this machine if the master is local, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of written tables that nothing reads any more; other tables stay as they are."""
    for df in tables:
        at = getattr(df, "written_at", None)
        if at:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def replaced(df: DataFrame, name: str, *spent: DataFrame) -> DataFrame:
    """df written and read back; the earlier rounds that it was made from are deleted."""
    out = written(df, name)
    discard(*spent)
    return out
