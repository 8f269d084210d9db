"""Sparse matrices as (i, j, v) tables: one row for each stored entry, no value twice.

Sums over rows and columns are aggregates or windows, products are joins on the inner index with partial sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sums this small are dropped by plus, entries this small by compact.
PLUS_ZERO, COMPACT_ZERO = 1e-8, 1e-7


def from_dense(array: DataFrame, rows: int) -> DataFrame:
    """Entries of a column-major array column `values` with `rows` rows, without zeros."""
    at = array.select(F.posexplode("values").alias("p", "v"))
    return at.where(F.abs("v") > PLUS_ZERO).select(F.pmod("p", F.lit(rows)).cast("long").alias("i"), F.expr(f"p div {rows}").alias("j"), F.col("v").cast("double").alias("v"))


def summed(m: DataFrame) -> DataFrame:
    """Repeated entries added up."""
    return m.groupBy("i", "j").agg(F.sum("v").alias("v"))


def to_dense(m: DataFrame, rows: int, cols: int) -> DataFrame:
    """One row: the column-major array of a small matrix."""
    cells = m.select(F.struct((F.col("j") * rows + F.col("i")).alias("p"), F.col("v")).alias("c")).agg(F.map_from_entries(F.collect_list("c")).alias("m"))
    return cells.select(F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda p: F.coalesce(F.element_at("m", p.cast("long")), F.lit(0.0))).alias("values"))


def transposed(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def powered(m: DataFrame, r: float) -> DataFrame:
    return m.withColumn("v", F.pow("v", F.lit(r)))


def absolute(m: DataFrame) -> DataFrame:
    return m.withColumn("v", F.abs("v"))


def totals(m: DataFrame) -> DataFrame:
    """One row: nnz, total, total_abs."""
    return m.agg(F.count_if(F.col("v") != 0).alias("nnz"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.abs("v")), F.lit(0.0)).alias("total_abs"))


def shape(m: DataFrame) -> DataFrame:
    """One row: rows and cols by the largest indices."""
    return m.agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("cols"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def _both(a: DataFrame, b: DataFrame, value: Column) -> DataFrame:
    return a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), ["i", "j"]).select("i", "j", value.alias("v"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, F.col("x") * F.col("y"))


def divided(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entry by entry; where the divisor is not stored or zero the entry is dropped."""
    return _both(a, b.where("v <> 0"), F.col("x") / F.col("y"))


def divided_by_row(a: DataFrame, row: DataFrame) -> DataFrame:
    """Each column divided by the row's (j, v) entry; columns without one are dropped."""
    return a.join(row.where("v <> 0").select("j", F.col("v").alias("y")), "j").select("i", "j", (F.col("v") / F.col("y")).alias("v"))


def plus(*parts: DataFrame) -> DataFrame:
    """The sum of matrices; sums within 1e-8 of zero are dropped."""
    rows = parts[0].select("i", "j", "v")
    for p in parts[1:]:
        rows = rows.unionByName(p.select("i", "j", "v"))
    return summed(rows).where(F.abs("v") > PLUS_ZERO)


def column_sums(m: DataFrame) -> DataFrame:
    """(j, v)."""
    return m.groupBy("j").agg(F.sum("v").alias("v"))


def normalized(m: DataFrame) -> DataFrame:
    """Columns divided by their sums; columns that sum to zero are dropped."""
    rows = m.withColumn("_sum", F.sum("v").over(Window.partitionBy("j")))
    return rows.where("_sum <> 0").select("i", "j", (F.col("v") / F.col("_sum")).alias("v"))


def pruned(m: DataFrame, t: float) -> DataFrame:
    """Entries larger than t in size."""
    return m.where(F.abs("v") > t) if t > 0 else m


def compacted(m: DataFrame) -> DataFrame:
    return m.where(F.abs("v") > COMPACT_ZERO)


def row_argmax(m: DataFrame, digits: int = 9) -> DataFrame:
    """(i, j): the column of each row's largest stored entry (to `digits`), the lowest of equals."""
    return m.groupBy("i").agg(F.max_by("j", F.struct(F.round("v", digits), -F.col("j"))).alias("j"))


def blocked(m: DataFrame, rows: int, cols: int) -> DataFrame:
    """(row_block, col_block, entries): entries by blocks of rows x cols, indices inside the block."""
    rows_ = m.select(F.expr(f"i div {rows}").alias("row_block"), F.expr(f"j div {cols}").alias("col_block"), F.struct(F.expr(f"i % {rows}").alias("i"), F.expr(f"j % {cols}").alias("j"), "v").alias("e"))
    return rows_.groupBy("row_block", "col_block").agg(F.array_sort(F.collect_list("e")).alias("entries"))


def unblocked(blocks: DataFrame, rows: int, cols: int) -> DataFrame:
    rows_ = blocks.select("row_block", "col_block", F.inline("entries"))
    return rows_.select((F.col("row_block") * rows + F.col("i")).alias("i"), (F.col("col_block") * cols + F.col("j")).alias("j"), "v")
