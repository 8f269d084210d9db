"""Agreement of clusters with annotations: (id, label) tables against (id, truth) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def annotated(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, label, truth) of the annotated ones."""
    return labels.join(truth.where("truth is not null"), "id")


def coverage(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: clustered, annotated and both."""
    rows = labels.select("id", F.lit(1).alias("c")).join(truth.where("truth is not null").select("id", F.lit(1).alias("t")), "id", "full")
    return rows.agg(F.count("c").alias("clustered"), F.count("t").alias("annotated"), F.count(F.expr("c + t")).alias("both"))


def _majority(pairs: DataFrame, by: str, of: str, least: int) -> DataFrame:
    cells = pairs.groupBy(by, of).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(by).agg(F.sum("n").alias("size"), (F.max("n") / F.sum("n")).alias("share"))
    return rows.where(F.col("size") >= least)


def purity(pairs: DataFrame, least: int = 1) -> DataFrame:
    """(label, size, share): the largest annotation's share of each cluster of `least` or more."""
    return _majority(pairs, "label", "truth", least)


def completeness(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(truth, size, share): the largest cluster's share of each annotation of `least` or more."""
    return _majority(pairs, "truth", "label", least)


def summary(shares: DataFrame) -> DataFrame:
    """One row: median, mean and whole (percent with share 1) of purity or completeness."""
    return shares.agg(F.percentile("share", 0.5).alias("median"), F.avg("share").alias("mean"), (100 * F.avg((F.col("share") == 1).cast("int"))).alias("whole"), F.count(F.lit(1)).alias("n"))


def nmi(pairs: DataFrame, least: int = 1) -> DataFrame:
    """One row: mutual information over the mean of the entropies, smoothed by 1e-13 and 1e-12; of annotations of `least` or more."""
    often = pairs.groupBy("truth").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    cells = pairs.join(often.select("truth"), "truth", "left_semi").groupBy("label", "truth").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("all"))
    row, col = cells.groupBy("label").agg(F.sum("n").alias("nl")), cells.groupBy("truth").agg(F.sum("n").alias("nt"))
    joint = cells.join(row, "label").join(col, "truth").join(F.broadcast(total))
    mutual = joint.agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nl") * F.col("nt")) + 1e-13)).alias("mi"))
    entropy = lambda t, c, name: t.join(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("all") * F.log(F.col(c) / F.col("all") + 1e-13))).alias(name))
    both = mutual.join(entropy(row, "nl", "hl")).join(entropy(col, "nt", "ht"))
    return both.select((F.col("mi") / ((F.col("hl") + F.col("ht")) / 2 + 1e-12)).alias("nmi"))


def largest(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The n largest clusters with their purity."""
    return purity(pairs).orderBy(F.desc("size"), "label").limit(n)
