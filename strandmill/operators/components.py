"""Connected components on edge tables by contraction.

Each round every vertex takes its smallest neighbour, or itself, as its parent; pointer jumping turns parents into the roots
of the trees this makes; edges are then relabelled by roots, and loops and repeats fall away. Every vertex with a smaller
neighbour vanishes, so the edges shrink fast and most work is in the first round: a star is done after one. State is
written to the shared checkpoint folder, so plans stay short and a lost executor costs a step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.state import discard, replaced, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): every vertex of the edges with the smallest id reachable from it.

    Edges are undirected; loops and repeated edges do no harm; edges with a null end are left out.
    """
    pairs = edges.where(f"{src} is not null and {dst} is not null").select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct()
    pairs = written(pairs, "cc-edges")
    labels = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), "cc-labels")
    all_pairs = pairs
    while pairs.where("a <> b").limit(1).count():
        pairs = pairs.where("a <> b")
        roots = written(_roots(pairs), "cc-roots")
        while True:
            up = roots.select(F.col("id").alias("root"), F.col("root").alias("up"))
            jumped = replaced(roots.select("id", "root").join(up, "root").select("id", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "cc-roots", roots)
            roots = jumped
            if not jumped.where("moved").limit(1).count():
                break
        roots_at, roots = roots, roots.select("id", "root")
        first, second = roots.withColumnsRenamed({"id": "a", "root": "ra"}), roots.withColumnsRenamed({"id": "b", "root": "rb"})
        near = pairs.join(first, "a").join(second, "b").where("ra <> rb")
        all_pairs = pairs = replaced(near.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges", all_pairs)
        moved = labels.join(roots.withColumnRenamed("id", "component"), "component", "left")
        labels = replaced(moved.select("id", F.coalesce("root", "component").alias("component")), "cc-labels", labels, roots_at)
    discard(all_pairs)
    return labels


def _roots(pairs: DataFrame) -> DataFrame:
    """(id, root): each vertex with the smaller of itself and its smallest neighbour; partial minima run before the shuffle."""
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return ends.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("root"))
