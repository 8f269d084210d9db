"""Edges between reads that share features: generation, filters, weights, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions import dna


def all_pairs(index: DataFrame) -> DataFrame:
    """(src, dst, n) for each pair in each list of `reads`; lists are bounded by the caller. n is the list's own, or 1."""
    head = index.select("reads", times(index), F.posexplode("reads").alias("at", "src"))
    later = head.select("src", "n", F.explode(F.slice(F.col("reads"), F.col("at") + 2, F.size("reads"))).alias("dst"))
    return later.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "n")


def times(index: DataFrame) -> Column:
    """How often a list stands for itself: its column n, or once."""
    return (F.col("n") if "n" in index.columns else F.lit(1).cast("long")).alias("n")


def ring_pairs(index: DataFrame, max_degree: int, seed: int = 0) -> DataFrame:
    """(src, dst, n) in lists longer than max_degree: in a seeded hash order each read meets the next ceil(max_degree / 2) + 1, round."""
    near = -(-max_degree // 2) + 1
    mixed = F.transform(F.array_sort(F.transform("reads", lambda x: F.struct(F.xxhash64(F.lit(seed), x).alias("h"), x.alias("id")))), lambda s: s["id"])
    rows = index.select(times(index), mixed.alias("reads")).select("reads", "n", F.posexplode("reads").alias("at", "a"))
    n = F.size("reads")
    rows = rows.select("a", "n", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(near), n - 1)), lambda i: F.element_at(F.col("reads"), F.pmod(F.col("at") + i, n) + 1))).alias("b"))
    return rows.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "n")


def shared(index: DataFrame, max_degree: int = 100, min_shared: int = 2, seed: int = 0, passes: int = 1, turn: int = 0) -> DataFrame:
    """(src, dst, w), src < dst: how many lists (each n times) a pair is drawn from, of at least min_shared; of several passes, the pairs of one turn."""
    short, long = index.where(F.size("reads") <= max_degree), index.where(F.size("reads") > max_degree)
    pairs = all_pairs(short).unionByName(ring_pairs(long, max_degree, seed))
    if passes > 1:
        pairs = residue(pairs, passes, turn)
    return pairs.groupBy("src", "dst").agg(F.sum("n").alias("w")).where(F.col("w") >= min_shared)


def every_shared(features: DataFrame, min_shared: int = 2, block: int = 1000) -> DataFrame:
    """(src, dst, w), src < dst: how many features (kmer, id) two ids share, of at least min_shared, without a cap.

    A feature of more than `block` ids is dealt into hashed blocks of about that many, and each pair of blocks is a row of its own.
    """
    rows = features.where("kmer is not null and id is not null").distinct()
    sizes = rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes.select("kmer", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "kmer")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = rows.groupBy("kmer", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).agg(
        F.array_sort(F.collect_list(F.when(F.col("own") <= F.col("other"), F.col("id")))).alias("reads"), F.array_sort(F.collect_list(F.when(F.col("own") > F.col("other"), F.col("id")))).alias("others")
    )
    across = held.where("p < q").select(F.explode("reads").alias("a"), "others").select("a", F.explode("others").alias("b"))
    pairs = all_pairs(held.where("p = q")).drop("n").unionByName(across.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")))
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") >= min_shared)


def residue(edges: DataFrame, n: int, i: int) -> DataFrame:
    """The share of edges of pass i of n."""
    return edges.where(F.pmod(F.col("src") + F.col("dst"), F.lit(n)) == i)


def in_range(edges: DataFrame, least: int = 2, most: int = 20000) -> DataFrame:
    return edges.where(F.col("w").between(least, most))


def normalized(edges: DataFrame) -> DataFrame:
    """Ends in ascending order, loops dropped."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest)


def merged(edges: DataFrame) -> DataFrame:
    """Parallel edges as one, with summed weights."""
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def vertex_range(edges: DataFrame, n: int, low: int, high: int) -> DataFrame:
    """Edges whose smaller end falls in residues low to high - 1 of n."""
    spot = F.pmod(F.least("src", "dst"), F.lit(n))
    return edges.where((spot >= low) & (spot < high))


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes (a column id)."""
    keep = nodes.select("id")
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def outside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with no end in nodes (a column id)."""
    drop = nodes.select("id")
    return edges.join(drop.withColumnRenamed("id", "src"), "src", "left_anti").join(drop.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def with_loops(directed: DataFrame, w=None) -> DataFrame:
    """One loop for each distinct source more; w is the loops' weight column where edges have one."""
    loops = directed.select("src").distinct().select("src", F.col("src").alias("dst"))
    if "w" in directed.columns:
        loops = loops.withColumn("w", F.lit(1.0) if w is None else w)
    return directed.unionByName(loops)


def weighted(edges: DataFrame, mode: str) -> DataFrame:
    return edges.withColumn("w", dna.overlap_weight(F.col("w"), mode))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edge ends at each vertex."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def vertex_count(edges: DataFrame) -> DataFrame:
    """One row: vertices."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.count_distinct("id").alias("vertices"))


def top_degree(ranked: DataFrame, ratio: float, group: str | None = None) -> DataFrame:
    """Vertices of the largest degrees, in each group: all as high as the floor(max(1, n * ratio))-th, ties included.

    The threshold comes from each group's histogram of degrees, so no task sorts a group's vertices.
    """
    keys = [group] if group else []
    histogram = ranked.groupBy(*keys, "degree").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    steps = histogram.withColumn("_upto", F.sum("_n").over(w.orderBy(F.desc("degree")))).withColumn("_all", F.sum("_n").over(w))
    want = F.floor(F.greatest(F.lit(1.0), F.col("_all") * F.lit(ratio)))
    cut = steps.where(F.col("_upto") >= want).groupBy(*keys).agg(F.max("degree").alias("_cut"))
    rows = ranked.join(cut, keys) if keys else ranked.join(F.broadcast(cut), F.col("degree") >= F.col("_cut"))
    return rows.where("degree >= _cut").drop("_cut")
