"""Graph clustering: components with hubs split off, label propagation, Markov clustering, affinity propagation.

Edges are (src, dst, w) tables; results are (id, label). Each round is one plan over the edge table, written to the shared
checkpoint folder before the next, so plans stay short however many rounds run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators import edges as E
from strandmill.operators import matrix
from strandmill.operators.components import connected_components
from strandmill.operators.state import discard, replaced, written


def contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst) between clusters: each edge's ends replaced by their labels."""
    first = edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("_s")), "src")
    both = first.join(labels.select(F.col("id").alias("dst"), F.col("label").alias("_d")), "dst")
    return both.select(F.col("_s").alias("src"), F.col("_d").alias("dst"))


def members(labels: DataFrame, least: int = 1) -> DataFrame:
    """(cluster_id, size, members): sorted members of each cluster of `least` or more; its id is its smallest member."""
    rows = labels.groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("members")).where(F.size("members") >= least)
    return rows.select(F.element_at("members", 1).alias("cluster_id"), F.size("members").alias("size"), "members")


def sized(labels: DataFrame, least: int) -> DataFrame:
    """Labels of clusters of `least` or more."""
    often = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("label")
    return labels.join(often, "label", "left_semi").select("id", "label")


def components(edges: DataFrame) -> DataFrame:
    return connected_components(edges).withColumnRenamed("component", "label")


def split_components(edges: DataFrame, top_nodes_ratio: float = 0.1, big_cluster_threshold: float = 0.2, min_size: int = 2) -> DataFrame:
    """(id, label): components, of which those with at least big_cluster_threshold of all vertices are split again and again.

    A split takes the vertices of the highest degrees in the cluster out as a cluster of their own, whatever its size, and
    takes the components of what is left; vertices that lose all edges drop out. All big clusters of a level go together.
    """
    edges = E.normalized(edges.select("src", "dst"))
    total = E.vertex_count(edges).first().vertices
    done, level = None, 0
    now = written(sized(components(edges), min_size), "split")
    while True:
        sizes = written(now.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "split-sizes")
        big = sizes.where(F.col("n") >= big_cluster_threshold * total).select("label")
        fine = now.join(big, "label", "left_anti").select("id", F.concat_ws(":", F.lit(level), "label").alias("label"))
        done = fine if done is None else done.unionByName(fine)
        if not big.limit(1).count():
            break
        inside = now.join(big, "label", "left_semi")
        held = edges.join(inside.select(F.col("id").alias("src"), F.col("label").alias("grp")), "src").join(inside.select(F.col("id").alias("dst"), F.col("label").alias("_g")), "dst").where("grp = _g").select("src", "dst", "grp")
        held = written(held, "split-edges")
        degree = held.select("grp", F.explode(F.array("src", "dst")).alias("id")).groupBy("grp", "id").agg(F.count(F.lit(1)).alias("degree"))
        hubs = written(E.top_degree(degree, top_nodes_ratio, "grp").select("id", "grp"), "split-hubs")
        done = done.unionByName(hubs.select("id", F.concat_ws(":", F.lit(f"{level} hubs"), "grp").alias("label")))
        edges = written(E.outside(held, hubs).select("src", "dst"), "split-rest")
        if not edges.limit(1).count():
            break
        now = written(sized(components(edges), min_size), "split")
        level += 1
    first = done.groupBy("label").agg(F.min("id").alias("_first"))
    return done.join(first, "label").select("id", F.col("_first").alias("label"))


def superstep(state: DataFrame, directed: DataFrame, message: Column, merge: Column, name: str) -> DataFrame:
    """One round of message passing: (id, name) with `merge` over the `message`s that edges src -> dst carry from state (id, ...)."""
    sent = directed.join(state.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), message.alias("message"))
    return sent.groupBy("id").agg(merge.alias(name))


def message_passing(state: DataFrame, directed: DataFrame, message: Column, merge: Column, update: Column, name: str, rounds: int) -> DataFrame:
    """Supersteps until no vertex gets a message that changes it, or for `rounds`: (id, name) with name := update.

    `message` may use the columns of state and edges, `update` the column `name` and the merged message `got`; a vertex without a
    message stays as it is.
    """
    for _ in range(rounds):
        got = superstep(state, directed, message, merge, "got")
        fresh = state.join(got, "id", "left").select("id", F.when(F.col("got").isNull(), F.col(name)).otherwise(update).alias("_new"), name)
        after = written(fresh.select("id", F.col("_new").alias(name), (~F.col("_new").eqNullSafe(F.col(name))).alias("_moved")), "messages")
        moved = after.where("_moved").limit(1).count()
        discard(state)
        state, at = after.select("id", name), after.written_at
        state.written_at = at
        if not moved:
            break
    return state


def _vote(votes: DataFrame) -> DataFrame:
    """(id, label): for each dst the label with the largest sum of w (to 1e-6), the smallest of equals."""
    sums = votes.groupBy("dst", "label").agg(F.round(F.sum("w"), 6).alias("total"))
    return sums.groupBy("dst").agg(F.max_by("label", F.struct(F.col("total"), -F.col("label"))).alias("label")).withColumnRenamed("dst", "id")


def lpa_sync(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Synchronous label propagation without a vote of one's own: every round each vertex takes its neighbours' most frequent label."""
    directed = written(E.symmetric(edges.select("src", "dst")), "lpa-edges")
    labels = directed.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = directed.join(labels.withColumnRenamed("id", "src"), "src").select("dst", "label", F.lit(1.0).alias("w"))
        labels = replaced(_vote(votes), "lpa", labels)
    return labels


def lpa(edges: DataFrame, rounds: int = 10, weight: str = "none", final: bool = True) -> DataFrame:
    """Label propagation with a vote of one's own (a loop of weight 1). Stops early when no label changes.

    weight: none counts edges, edge sums shared features, logedge their logarithms. One update more is made at the end.
    """
    directed = E.symmetric(E.weighted(edges.select("src", "dst", *(["w"] if "w" in edges.columns else [F.lit(1).alias("w")])), weight))
    directed = written(E.with_loops(directed), "lpa-edges")
    labels = directed.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))

    def turn(labels: DataFrame) -> DataFrame:
        return _vote(directed.join(labels.withColumnRenamed("id", "src"), "src").select("dst", "label", "w"))

    for _ in range(rounds):
        after = written(turn(labels), "lpa")
        changed = after.join(labels.withColumnRenamed("label", "_old"), "id").where("label <> _old").limit(1).count()
        discard(labels)
        labels = after
        if not changed:
            break
    return turn(labels) if final else labels


def with_preference(edges: DataFrame, scaling: float, per_source: bool = False) -> DataFrame:
    """Symmetric (src, dst, w) with loops weighted by the median weight times scaling: of all edges, or of each source's."""
    both = E.symmetric(edges.select("src", "dst", F.col("w").cast("double").alias("w")))
    if per_source:
        loops = both.groupBy("src").agg((F.percentile("w", 0.5) * scaling).alias("w")).select("src", F.col("src").alias("dst"), "w")
    else:
        spread = both.groupBy("w").agg(F.count(F.lit(1)).alias("n"))  # one row for each weight reaches the task that takes the median
        median = spread.agg((F.percentile("w", 0.5, F.col("n")) * scaling).alias("w"))
        loops = both.select("src").distinct().join(F.broadcast(median)).select("src", F.col("src").alias("dst"), "w")
    return both.unionByName(loops)


def markov(edges: DataFrame, rounds: int = 10, inflation: float = 2.0, scaling: float = 1.0, weight: str = "edge", prune: float = 0.0, convergence_rounds: int = 0) -> DataFrame:
    """Markov clustering: with column-stochastic M, M := normalize((M M) ^ inflation); a row's label is its largest entry's column.

    Runs `rounds` rounds, or ends when labels have stayed for convergence_rounds (0: never early). Entries up to `prune` are dropped.
    """
    m = with_preference(E.weighted(edges, weight), scaling).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("v"))
    m = written(matrix.normalized(matrix.summed(m)), "mcl")
    labels, calm = None, 0
    for _ in range(rounds):
        m = replaced(matrix.normalized(matrix.pruned(matrix.powered(matrix.product(m, m), inflation), prune)), "mcl", m)
        if convergence_rounds:
            after = written(matrix.row_argmax(m), "mcl-labels")
            same = labels is not None and not after.join(labels.withColumnRenamed("j", "_old"), "i").where("j <> _old").limit(1).count()
            if labels is not None:
                discard(labels)
            labels, calm = after, calm + 1 if same else 0
            if calm >= convergence_rounds:
                break
    return matrix.row_argmax(m).select(F.col("i").alias("id"), F.col("j").alias("label"))


def affinity_start(edges: DataFrame, scaling: float = 1.0, weight: str = "edge") -> DataFrame:
    """(src, dst, s, r, a): the mean of repeated similarities, no messages yet."""
    rows = with_preference(E.weighted(edges, weight), scaling)
    return rows.groupBy("src", "dst").agg(F.avg("w").alias("s")).withColumn("r", F.lit(0.0)).withColumn("a", F.lit(0.0))


def affinity_round(state: DataFrame, damping: float = 0.5) -> DataFrame:
    """Responsibilities, then availabilities, over the existing edges, both damped.

    r(i,k) := s(i,k) - max over other k' of (s + a)(i,k'); just s(i,k) for a source with one edge. With S(k) the sum of positive r into k,
    a(k,k) := S(k) - max(0, r(k,k)) and a(i,k) := min(0, r(k,k) + S(k) - max(0, r(k,k)) - max(0, r(i,k))).
    """
    own = Window.partitionBy("src")
    order = own.orderBy(F.desc(F.col("s") + F.col("a")), "dst")
    rows = state.withColumn("_rank", F.row_number().over(order))
    first = F.max(F.when(F.col("_rank") == 1, F.col("s") + F.col("a"))).over(own)
    second = F.max(F.when(F.col("_rank") == 2, F.col("s") + F.col("a"))).over(own)
    other = F.when(F.col("_rank") == 1, second).otherwise(first)
    fresh = F.when(F.count(F.lit(1)).over(own) == 1, F.col("s")).otherwise(F.col("s") - other)
    rows = rows.withColumn("r", damping * F.col("r") + (1 - damping) * fresh).drop("_rank")
    into = Window.partitionBy("dst")
    self_r = F.max(F.when(F.col("src") == F.col("dst"), F.col("r"))).over(into)
    positive = F.sum(F.greatest(F.col("r"), F.lit(0.0))).over(into)
    rest = self_r + positive - F.greatest(self_r, F.lit(0.0)) - F.greatest(F.col("r"), F.lit(0.0))
    fresh = F.when(F.col("src") == F.col("dst"), positive - F.greatest(F.col("r"), F.lit(0.0))).otherwise(F.least(F.lit(0.0), rest))
    return rows.withColumn("a", damping * F.col("a") + (1 - damping) * fresh)


def exemplars(state: DataFrame, digits: int = 9) -> DataFrame:
    """(id, label): for each source the dst with the largest r + a (to `digits`), the smallest of equals."""
    best = F.max_by("dst", F.struct(F.round(F.col("r") + F.col("a"), digits), -F.col("dst")))
    return state.groupBy("src").agg(best.alias("label")).withColumnRenamed("src", "id")


def affinity(edges: DataFrame, rounds: int = 10, damping: float = 0.5, scaling: float = 1.0, convergence_rounds: int = 3, weight: str = "edge") -> DataFrame:
    """Affinity propagation until exemplars have stayed for convergence_rounds, or for `rounds` rounds."""
    if not 0.5 <= damping <= 1:
        raise ValueError("damping must be in [0.5, 1]")
    state = written(affinity_start(edges, scaling, weight), "ap")
    labels, calm = None, 0
    for _ in range(rounds):
        state = replaced(affinity_round(state, damping), "ap", state)
        after = written(exemplars(state), "ap-labels")
        same = labels is not None and not after.join(labels.withColumnRenamed("label", "_old"), "id").where("label <> _old").limit(1).count()
        if labels is not None:
            discard(labels)
        labels, calm = after, calm + 1 if same else 0
        if calm >= convergence_rounds:
            break
    return labels
