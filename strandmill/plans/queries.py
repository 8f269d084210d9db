"""Registered queries over the standard tables, each with the SQL that gives the same rows where SQL can.

Reads are documents whose letters are mapped to bases (q to N). Two graphs come from lineitem: orders that share two
parts or more, and matrices of quantities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import dna
from strandmill.operators import blocks, clustering, edges, evaluation, kmers, matrix, overlap
from strandmill.operators.state import folder, written
from strandmill.plans import chain, cli
from strandmill.sources import readers, writers

K = 31
LETTERS, MAPPED = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTNCGTACGTAC"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, MAPPED)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), seq.alias("seq"))


READS = f"r AS (SELECT doc_id AS id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{MAPPED}') AS seq FROM documents)"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
WINDOWS = f"{READS}, p AS (SELECT id, unnest(string_split(seq, 'N')) AS p FROM r), w AS (SELECT id, p[i:i+{K - 1}] AS x FROM (SELECT id, p, unnest(range(1, length(p) - {K - 2})) AS i FROM p WHERE length(p) >= {K}))"
CANONICAL = f"{WINDOWS}, f AS (SELECT DISTINCT id, least(x, {RC.format('x')}) AS kmer FROM w)"
BOTH = f"{WINDOWS}, f AS (SELECT DISTINCT id, unnest([x, {RC.format('x')}]) AS kmer FROM w)"
COUNTS = "c AS (SELECT kmer, count(*) AS cnt FROM f GROUP BY kmer HAVING count(*) > 1)"


def features(spark: SparkSession, sf_dir: str, strands: str = "canonical") -> DataFrame:
    return kmers.explode(reads(spark, sf_dir), K, strands)


def named(df: DataFrame) -> DataFrame:
    return df.withColumn("kmer", dna.from_code(F.col("kmer"), K))


# Sequences and packed forms.


@query(f"WITH {READS} SELECT id, md5({RC.format('seq')}) AS rc FROM r")
def reverse_complement(spark, sf_dir):
    return reads(spark, sf_dir).select("id", F.md5(dna.reverse_complement(F.col("seq"))).alias("rc"))


@query(f"WITH {READS} SELECT id, md5(least(seq, {RC.format('seq')})) AS canonical FROM r")
def canonical_sequence(spark, sf_dir):
    return reads(spark, sf_dir).select("id", F.md5(dna.canonical(F.col("seq"))).alias("canonical"))


@query(f"WITH {READS} SELECT id, CAST((length(replace(seq, 'N', '')) + 3) // 4 AS BIGINT) AS bytes, md5(replace(seq, 'N', '')) AS seq FROM r")
def pack_unpack(spark, sf_dir):
    rows = reads(spark, sf_dir).select("id", F.replace("seq", F.lit("N"), F.lit("")).alias("seq"))
    rows = rows.withColumn("packed", dna.pack(F.col("seq")))
    return rows.select("id", F.octet_length("packed").cast("long").alias("bytes"), F.md5(dna.unpack(F.col("packed"), F.length("seq"))).alias("seq"))


@query(f"WITH {CANONICAL}, {COUNTS} SELECT kmer, cnt, to_base64(unhex(printf('%016x', list_reduce(list_transform(string_split(translate(kmer || 'A', 'ATCG', '0123'), ''), lambda d: CAST(d AS UBIGINT)), lambda a, b: a * 4 + b)))) AS packed FROM c")
def pack_kmer_base64(spark, sf_dir):
    rows = named(kmers.counts(features(spark, sf_dir)))
    packed = dna.kmer_base64(F.col("kmer"))
    return rows.select(dna.base64_kmer(packed, K).alias("kmer"), "cnt", packed.alias("packed"))


@query("SELECT o_orderkey, to_base64(unhex(printf('%016x', o_orderkey))) AS packed, to_base64(unhex(printf('%08x', o_orderkey))) AS packed4, o_orderkey AS back FROM orders")
def long_base64(spark, sf_dir):
    packed = dna.long_base64(F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", packed.alias("packed"), dna.int_base64(F.col("o_orderkey")).alias("packed4"), dna.base64_long(packed).alias("back"))


@query("SELECT l_orderkey, l_linenumber, CAST(((l_partkey - l_orderkey) % 7 + 7) % 7 AS BIGINT) AS m FROM lineitem")
def pos_mod(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", dna.pos_mod(F.col("l_partkey") - F.col("l_orderkey"), 7).alias("m"))


@query("WITH q AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS k FROM lineitem) SELECT l_orderkey, median(q) AS med, string_agg(CAST(k AS VARCHAR), ',' ORDER BY q, k) AS ranks FROM q GROUP BY l_orderkey")
def array_argsort(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q")))).alias("a"))
    q = F.transform("a", lambda s: s["q"])
    return rows.select("l_orderkey", dna.median_of(q).alias("med"), F.array_join(dna.argsort(q).cast("array<string>"), ",").alias("ranks"))


# K-mers.


@query(f"WITH {CANONICAL}, {COUNTS} SELECT * FROM c")
def kmer_count_canonical(spark, sf_dir):
    return named(kmers.counts(features(spark, sf_dir)))


@query(f"WITH {BOTH}, {COUNTS} SELECT * FROM c")
def kmer_count_both(spark, sf_dir):
    return named(blocks.counts(reads(spark, sf_dir), K, "both"))


@query(f"WITH {CANONICAL}, {COUNTS} SELECT * FROM c")
def kmer_count_expressions(spark, sf_dir):
    return kmers.counts(kmers.explode(reads(spark, sf_dir), K, impl="expr"))


@query(f"WITH {CANONICAL}, {COUNTS} SELECT * FROM c")
def kmer_residue_passes(spark, sf_dir):
    rows = features(spark, sf_dir)
    first, *rest = [kmers.counts(kmers.residue(rows, 2, i)) for i in range(2)]
    for more in rest:
        first = first.unionByName(more)
    return named(first)


@query(f"WITH {BOTH}, {COUNTS} SELECT * FROM c WHERE kmer LIKE 'ACG%'")
def kmer_prefix_filter(spark, sf_dir):
    return kmers.counts(kmers.explode(reads(spark, sf_dir), K, "both", prefix="ACG"))


@query(f"WITH {CANONICAL}, {COUNTS}, t AS (SELECT kmer, cnt, row_number() OVER (ORDER BY cnt DESC, translate(kmer, 'ATCG', '0123')) AS i, count(*) OVER () AS n FROM c) SELECT kmer, cnt FROM t WHERE i <= floor(n * 0.001) + 1")
def kmer_top_fraction(spark, sf_dir):
    return named(kmers.top_fraction(written(blocks.counts(reads(spark, sf_dir), K), "kmer-counts"), 0.001))


@query(f"WITH {CANONICAL} SELECT kmer, count(*) AS n, array_to_string(list(id ORDER BY id), ',') AS reads FROM f GROUP BY kmer HAVING count(*) >= 2 AND count(*) <= 200")
def kmer_inverted_index(spark, sf_dir):
    index = blocks.inverted_index(reads(spark, sf_dir), K, 201).where(F.size("reads") <= 200)
    return named(index.select("kmer", F.size("reads").cast("long").alias("n"), F.array_join(F.col("reads").cast("array<string>"), ",").alias("reads")))


@query(f"WITH {CANONICAL}, {COUNTS}, t AS (SELECT kmer, row_number() OVER (ORDER BY cnt DESC, translate(kmer, 'ATCG', '0123')) AS i, count(*) OVER () AS n FROM c), k AS (SELECT kmer, count(*) AS n FROM f WHERE kmer NOT IN (SELECT kmer FROM t WHERE i <= floor(n * 0.01) + 1) GROUP BY kmer HAVING count(*) >= 2) SELECT kmer, least(n, 10) AS n FROM k")
def kmer_contaminants_cap(spark, sf_dir):
    rows = features(spark, sf_dir)
    index = kmers.inverted_index(rows, 2, 10, kmers.top_fraction(written(kmers.counts(rows), "kmer-counts"), 0.01))
    return named(index.select("kmer", F.size("reads").cast("long").alias("n")))


# Edges.

PAIRS = "e AS (SELECT a.id AS src, b.id AS dst, count(*) AS w FROM f a JOIN f b USING (kmer) WHERE a.id < b.id GROUP BY ALL HAVING count(*) >= 2)"
ORDERS = f"f AS (SELECT DISTINCT l_partkey AS kmer, l_orderkey AS id FROM lineitem), {PAIRS}"


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("kmer"), F.col("l_orderkey").alias("id")).distinct()
    return edges.every_shared(rows, 2)


@query(f"WITH {ORDERS} SELECT * FROM e")
def edges_orders(spark, sf_dir):
    return order_edges(spark, sf_dir)


@query()
def edges_documents(spark, sf_dir):
    return chain.read_edges(reads(spark, sf_dir), K, contamination=0.0, max_kmer_count=200, max_degree=100)


@query()
def edges_sampled_ring(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("kmer"), F.col("l_orderkey").alias("id")).distinct()
    return edges.shared(kmers.inverted_index(rows, 2, 1000), 10, 1)


@query(f"WITH {ORDERS} SELECT * FROM e WHERE w BETWEEN 3 AND 20000")
def edges_range(spark, sf_dir):
    return edges.in_range(order_edges(spark, sf_dir), 3)


@query(f"WITH {ORDERS}, d AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) SELECT src, dst, round(ln(w), 6) AS w FROM d UNION ALL SELECT DISTINCT src, src, 1.0 FROM d")
def edges_symmetric_log(spark, sf_dir):
    rows = edges.with_loops(edges.symmetric(edges.weighted(order_edges(spark, sf_dir), "logedge")))
    return rows.select("src", "dst", F.round("w", 6).alias("w"))


@query(f"WITH {ORDERS}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id), k AS (SELECT degree AS cut FROM d ORDER BY degree DESC LIMIT 1 OFFSET (SELECT CAST(floor(greatest(1, count(*) * 0.01)) AS BIGINT) - 1 FROM d)) SELECT id, degree FROM d, k WHERE degree >= cut")
def top_degree(spark, sf_dir):
    return edges.top_degree(edges.degrees(order_edges(spark, sf_dir)), 0.01)


@query(f"WITH {ORDERS} SELECT count(DISTINCT id) AS vertices FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e)")
def vertex_count(spark, sf_dir):
    return edges.vertex_count(order_edges(spark, sf_dir))


@query(f"WITH {ORDERS} SELECT src, dst, w FROM e WHERE (src + dst) % 3 = 1 AND src % 4 IN (1, 2)")
def edges_residue_range(spark, sf_dir):
    return edges.vertex_range(edges.residue(order_edges(spark, sf_dir), 3, 1), 4, 1, 3)


@query(f"WITH {ORDERS}, o AS (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority < '3') SELECT src, dst, w, 'among' AS kind FROM e WHERE src IN (FROM o) AND dst IN (FROM o) UNION ALL SELECT src, dst, w, 'outside' FROM e WHERE src NOT IN (FROM o) AND dst NOT IN (FROM o)")
def edges_node_sets(spark, sf_dir):
    nodes = table(spark, sf_dir, "orders").where("o_orderpriority < '3'").select(F.col("o_orderkey").alias("id"))
    rows = order_edges(spark, sf_dir)
    return edges.among(rows, nodes).withColumn("kind", F.lit("among")).unionByName(edges.outside(rows, nodes).withColumn("kind", F.lit("outside")))


@query()
def overlap_edges(spark, sf_dir):
    rows = chain.read_edges(reads(spark, sf_dir), K, contamination=0.0, max_kmer_count=200, min_shared=2)
    return overlap.overlap_edges(rows, reads(spark, sf_dir), 31)


# Clustering.

COMPONENTS = "d AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), reach AS (SELECT DISTINCT src AS id, src AS root FROM d UNION SELECT d.dst, reach.root FROM reach JOIN d ON d.src = reach.id), cc AS (SELECT id, min(root) AS label FROM reach GROUP BY id)"


@query(f"WITH RECURSIVE {ORDERS}, {COMPONENTS} SELECT * FROM cc")
def cc(spark, sf_dir):
    return clustering.components(order_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {ORDERS}, {COMPONENTS} SELECT min(id) AS cluster_id, count(*) AS size, array_to_string(list(id ORDER BY id), ',') AS members FROM cc GROUP BY label HAVING count(*) >= 3")
def cluster_members(spark, sf_dir):
    rows = clustering.members(clustering.components(order_edges(spark, sf_dir)), 3)
    return rows.select("cluster_id", F.col("size").cast("long").alias("size"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"WITH RECURSIVE {ORDERS}, {COMPONENTS} SELECT DISTINCT a.label AS src, b.label AS dst FROM e JOIN cc a ON a.id = e.src JOIN cc b ON b.id = e.dst")
def cc_contract(spark, sf_dir):
    rows = order_edges(spark, sf_dir)
    return clustering.contracted(rows, clustering.components(rows)).distinct()


@query()
def cc_big_split(spark, sf_dir):
    return clustering.split_components(order_edges(spark, sf_dir), 0.05, 0.05)


@query(f"WITH RECURSIVE {ORDERS}, {COMPONENTS} SELECT o_orderpriority AS head, label FROM cc JOIN orders ON o_orderkey = id")
def cluster_label_join(spark, sf_dir):
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("head"))
    return clustering.components(order_edges(spark, sf_dir)).join(heads, "id").select("head", "label")


def lpa_sql(rounds: int, weight: str, loops: bool) -> str:
    """Unrolled label propagation over e."""
    w = {"none": "CAST(1 AS DOUBLE)", "edge": "CAST(w AS DOUBLE)", "logedge": "ln(w)"}[weight]
    loop = " UNION ALL SELECT DISTINCT src, src, 1.0 FROM s" if loops else ""
    parts = [f"s AS (SELECT src, dst, {w} AS w FROM e UNION ALL SELECT dst, src, {w} FROM e), d AS MATERIALIZED (SELECT * FROM s{loop}), l0 AS (SELECT DISTINCT src AS id, src AS label FROM d)"]
    for i in range(1, rounds + 1):
        parts.append(f"v{i} AS (SELECT dst AS id, label, round(sum(w), 6) AS t FROM d JOIN l{i - 1} l ON l.id = d.src GROUP BY dst, label), l{i} AS MATERIALIZED (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY t DESC, label) AS k FROM v{i}) WHERE k = 1)")
    return ", ".join(parts) + f" SELECT id, label FROM l{rounds}"


@query(f"WITH {ORDERS}, {lpa_sql(4, 'none', True)}")
def lpa_self(spark, sf_dir):
    return clustering.lpa(order_edges(spark, sf_dir), 3)


@query(f"WITH {ORDERS}, {lpa_sql(4, 'edge', True)}")
def lpa_weighted(spark, sf_dir):
    return clustering.lpa(order_edges(spark, sf_dir), 3, "edge")


@query(f"WITH {ORDERS}, {lpa_sql(4, 'logedge', True)}")
def lpa_log_weighted(spark, sf_dir):
    return clustering.lpa(order_edges(spark, sf_dir), 3, "logedge")


@query(f"WITH {ORDERS}, {lpa_sql(3, 'none', False)}")
def lpa_sync(spark, sf_dir):
    return clustering.lpa_sync(order_edges(spark, sf_dir), 3)


@query(f"WITH {ORDERS}, d AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) SELECT dst AS id, min(src) AS low FROM d GROUP BY dst")
def pregel_superstep(spark, sf_dir):
    both = edges.symmetric(order_edges(spark, sf_dir).select("src", "dst"))
    state = both.select(F.col("src").alias("id")).distinct()
    return clustering.superstep(state, both, F.col("src"), F.min("message"), "low")


LOOPED = "s AS (SELECT src, dst, CAST(w AS DOUBLE) AS w FROM e UNION ALL SELECT dst, src, CAST(w AS DOUBLE) FROM e), d AS (SELECT src, dst, w FROM s UNION ALL SELECT DISTINCT src, src, (SELECT median(w) FROM s) FROM s)"


def mcl_sql(rounds: int) -> str:
    parts = ["m0 AS MATERIALIZED (SELECT src AS i, dst AS j, w / sum(w) OVER (PARTITION BY dst) AS v FROM d)"]
    for i in range(1, rounds + 1):
        parts.append(f"p{i} AS (SELECT a.i, b.j, sum(a.v * b.v) ** 2 AS v FROM m{i - 1} a JOIN m{i - 1} b ON a.j = b.i GROUP BY a.i, b.j), m{i} AS MATERIALIZED (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM p{i})")
    return ", ".join(parts) + f" SELECT id, label FROM (SELECT i AS id, j AS label, row_number() OVER (PARTITION BY i ORDER BY round(v, 9) DESC, j) AS k FROM m{rounds}) WHERE k = 1"


@query(f"WITH {ORDERS}, {LOOPED}, {mcl_sql(3)}")
def mcl(spark, sf_dir):
    return clustering.markov(order_edges(spark, sf_dir), 3)


def ap_sql(rounds: int) -> str:
    parts = ["a0 AS (SELECT src, dst, w AS s, 0.0::DOUBLE AS r, 0.0::DOUBLE AS a FROM d)"]
    for i in range(1, rounds + 1):
        parts.append(
            f"x{i} AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s + a DESC, dst) AS k, count(*) OVER (PARTITION BY src) AS n FROM a{i - 1}), "
            f"y{i} AS (SELECT *, max(CASE WHEN k = 1 THEN s + a END) OVER (PARTITION BY src) AS m1, max(CASE WHEN k = 2 THEN s + a END) OVER (PARTITION BY src) AS m2 FROM x{i}), "
            f"z{i} AS (SELECT src, dst, s, a, 0.5 * r + 0.5 * (CASE WHEN n = 1 THEN s WHEN k = 1 THEN s - m2 ELSE s - m1 END) AS r FROM y{i}), "
            f"q{i} AS (SELECT *, max(CASE WHEN src = dst THEN r END) OVER (PARTITION BY dst) AS rkk, sum(greatest(r, 0)) OVER (PARTITION BY dst) AS pos FROM z{i}), "
            f"a{i} AS MATERIALIZED (SELECT src, dst, s, r, 0.5 * a + 0.5 * (CASE WHEN src = dst THEN pos - greatest(r, 0) ELSE least(0, rkk + pos - greatest(rkk, 0) - greatest(r, 0)) END) AS a FROM q{i})"
        )
    return ", ".join(parts) + f" SELECT id, label FROM (SELECT src AS id, dst AS label, row_number() OVER (PARTITION BY src ORDER BY round(r + a, 9) DESC, dst) AS k FROM a{rounds}) WHERE k = 1"


@query(f"WITH {ORDERS}, {LOOPED}, {ap_sql(3)}")
def affinity_propagation(spark, sf_dir):
    return clustering.affinity(order_edges(spark, sf_dir), 3, convergence_rounds=4)


# Matrices: suppliers by line number, and line numbers by month, of summed quantities.

A = "a AS (SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(l_linenumber AS BIGINT) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
B = "b AS (SELECT CAST(l_linenumber AS BIGINT) AS i, CAST(month(l_shipdate) AS BIGINT) AS j, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)"
C = "c AS (SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(l_linenumber AS BIGINT) AS j, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)"


def mat(spark, sf_dir, i: str, j: str, where: str = "true") -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(where)
    return rows.groupBy(F.expr(i).cast("long").alias("i"), F.expr(j).cast("long").alias("j")).agg(F.sum("l_quantity").alias("v"))


def mat_a(spark, sf_dir):
    return mat(spark, sf_dir, "l_suppkey", "l_linenumber")


def mat_b(spark, sf_dir):
    return mat(spark, sf_dir, "l_linenumber", "month(l_shipdate)", "l_returnflag = 'R'")


def mat_c(spark, sf_dir):
    return mat(spark, sf_dir, "l_suppkey", "l_linenumber", "l_returnflag = 'R'")


@query(f"WITH {A} SELECT j AS i, i AS j, v FROM a")
def mat_transpose(spark, sf_dir):
    return matrix.transposed(mat_a(spark, sf_dir))


@query(f"WITH {A} SELECT i, j, v ** 2 AS v FROM a")
def mat_pow(spark, sf_dir):
    return matrix.powered(mat_a(spark, sf_dir), 2)


@query(f"WITH {A}, {C} SELECT i, j, sum(v) AS v FROM (FROM a UNION ALL SELECT i, j, -v FROM c) GROUP BY i, j HAVING abs(sum(v)) > 1e-8")
def mat_plus(spark, sf_dir):
    return matrix.plus(mat_a(spark, sf_dir), mat_c(spark, sf_dir).withColumn("v", -F.col("v")))


@query(f"WITH {A}, {C} SELECT i, j, a.v * c.v AS v FROM a JOIN c USING (i, j)")
def mat_hadamard(spark, sf_dir):
    return matrix.hadamard(mat_a(spark, sf_dir), mat_c(spark, sf_dir))


@query(f"WITH {A}, {C} SELECT i, j, round(c.v / a.v, 9) AS v FROM a JOIN c USING (i, j) WHERE a.v <> 0")
def mat_divide(spark, sf_dir):
    return matrix.divided(mat_c(spark, sf_dir), mat_a(spark, sf_dir)).withColumn("v", F.round("v", 9))


@query(f"WITH {A}, {B} SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a JOIN b ON a.j = b.i GROUP BY a.i, b.j")
def mat_mmult(spark, sf_dir):
    return matrix.product(mat_a(spark, sf_dir), mat_b(spark, sf_dir))


@query(f"WITH {A} SELECT j, sum(v) AS v FROM a GROUP BY j")
def mat_colsum(spark, sf_dir):
    return matrix.column_sums(mat_a(spark, sf_dir))


@query(f"WITH {A} SELECT i, j, round(v / sum(v) OVER (PARTITION BY j), 9) AS v FROM a")
def mat_normalize(spark, sf_dir):
    return matrix.normalized(mat_a(spark, sf_dir)).withColumn("v", F.round("v", 9))


@query(f"WITH {A} SELECT i, j, v FROM a WHERE abs(v) > 500")
def mat_prune(spark, sf_dir):
    return matrix.compacted(matrix.pruned(mat_a(spark, sf_dir), 500))


@query(f"WITH {A} SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS k FROM a) WHERE k = 1")
def mat_argmax(spark, sf_dir):
    return matrix.row_argmax(mat_a(spark, sf_dir))


@query(f"WITH {A} SELECT count(*) FILTER (v <> 0) AS nnz, sum(v - 300) AS total, sum(abs(v - 300)) AS total_abs FROM a".replace("FILTER (v <> 0)", "FILTER (v <> 300)"))
def mat_sums(spark, sf_dir):
    return matrix.totals(mat_a(spark, sf_dir).withColumn("v", F.col("v") - 300))


@query(f"WITH {A} SELECT i, j, v FROM a")
def mat_block_roundtrip(spark, sf_dir):
    return matrix.unblocked(matrix.blocked(mat_a(spark, sf_dir), 16, 3), 16, 3)


@query(f"WITH {A} SELECT max(i) + 1 AS rows, max(j) + 1 AS cols FROM a")
def mat_shape(spark, sf_dir):
    return matrix.shape(mat_a(spark, sf_dir))


# Evaluation: orders labelled by the customer's nation, annotated by priority.

ANNOTATED = "p AS (SELECT o_orderkey AS id, c_nationkey AS label, o_orderpriority AS truth FROM orders JOIN customer ON c_custkey = o_custkey), cells AS (SELECT label, truth, count(*) AS n FROM p GROUP BY ALL)"


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    labels = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("label"))
    return evaluation.annotated(labels, orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("truth")))


PURITY = "q AS (SELECT label, CAST(sum(n) AS BIGINT) AS size, max(n) / sum(n) AS share FROM cells GROUP BY label)"


@query(f"WITH {ANNOTATED}, {PURITY} SELECT label, size, round(share, 9) AS share FROM q")
def cluster_purity(spark, sf_dir):
    return evaluation.purity(annotated(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(f"WITH {ANNOTATED} SELECT truth, CAST(sum(n) AS BIGINT) AS size, round(max(n) / sum(n), 9) AS share FROM cells GROUP BY truth HAVING sum(n) >= 3")
def label_completeness(spark, sf_dir):
    return evaluation.completeness(annotated(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(f"WITH {ANNOTATED}, {PURITY} SELECT round(median(share), 9) AS median, round(avg(share), 9) AS mean, round(100 * avg(CASE WHEN share = 1 THEN 1 ELSE 0 END), 9) AS whole, count(*) AS n FROM q")
def purity_summary(spark, sf_dir):
    rows = evaluation.summary(evaluation.purity(annotated(spark, sf_dir)))
    return rows.select(*[F.round(c, 9).alias(c) for c in ("median", "mean", "whole")], "n")


@query(f"WITH {ANNOTATED}, t AS (SELECT sum(n) AS al FROM cells), l AS (SELECT label, sum(n) AS nl FROM cells GROUP BY label), u AS (SELECT truth, sum(n) AS nt FROM cells GROUP BY truth) SELECT round((SELECT sum(n / al * ln(n * al / (nl * nt) + 1e-13)) FROM cells JOIN l USING (label) JOIN u USING (truth), t) / (((SELECT -sum(nl / al * ln(nl / al + 1e-13)) FROM l, t) + (SELECT -sum(nt / al * ln(nt / al + 1e-13)) FROM u, t)) / 2 + 1e-12), 9) AS nmi")
def nmi(spark, sf_dir):
    return evaluation.nmi(annotated(spark, sf_dir)).withColumn("nmi", F.round("nmi", 9))


@query(f"WITH {ANNOTATED}, {PURITY} SELECT label, size, round(share, 9) AS share FROM q ORDER BY size DESC, label LIMIT 10")
def top_clusters(spark, sf_dir):
    return evaluation.largest(annotated(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query("SELECT (SELECT count(*) FROM documents) AS clustered, (SELECT count(*) FROM labels WHERE quality IS NOT NULL) AS annotated, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL) AS both")
def annotation_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    truth = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("truth"))
    return evaluation.coverage(docs, truth)


# Forms of reads.


@query(f"WITH {READS} SELECT id, md5(array_to_string(list_filter(string_split(seq, 'N'), lambda x: x <> ''), 'N')) AS seq FROM r")
def base64_roundtrip(spark, sf_dir):
    return readers.base64_reads(writers.base64_lines(reads(spark, sf_dir))).select("id", F.md5("seq").alias("seq"))


def _lines(spark: SparkSession, sf_dir: str, *parts) -> DataFrame:
    rows = reads(spark, sf_dir).orderBy("id")
    return rows.select(F.explode(F.array(*parts)).alias("value"))


@query(f"WITH {READS} SELECT row_number() OVER (ORDER BY id) - 1 AS n, 'd' || id AS head, md5(seq) AS seq FROM r")
def fasta_parse(spark, sf_dir):
    lines = _lines(spark, sf_dir, F.concat(F.lit(">d"), "id"), F.lower("seq"))
    return readers.fasta(lines).select("n", "head", F.md5("seq").alias("seq"))


@query(f"WITH {READS}, o AS (SELECT id, seq, row_number() OVER (ORDER BY id) - 1 AS k FROM r) SELECT k // 2 AS n, min_by('d' || id, k) AS head, md5(string_agg(seq, 'N' ORDER BY k)) AS seq FROM o GROUP BY k // 2")
def fastq_pair_join(spark, sf_dir):
    lines = _lines(spark, sf_dir, F.concat(F.lit("@d"), "id"), F.lower("seq"), F.lit("+"), F.lit("I"))
    return readers.fastq(lines, paired=True).select("n", "head", F.md5("seq").alias("seq"))


@query("SELECT count(*) AS n, min(k) AS low, max(k) AS high FROM (SELECT row_number() OVER () - 1 AS k FROM documents)")
def add_ids(spark, sf_dir):
    rows = readers.with_ids(reads(spark, sf_dir).select(F.col("id").cast("string").alias("head"), "seq"))
    return rows.agg(F.count_distinct("id").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


@query()
def sample_reads(spark, sf_dir):
    return reads(spark, sf_dir).sample(False, 0.1, 7).select("id", F.length("seq").alias("bases"))


# Files: each form written, and read back.


def stored(spark: SparkSession, name: str) -> str:
    return folder(spark, f"files-{name}")


@query(f"WITH {READS} SELECT id, 'd' || id AS head, md5(seq) AS seq FROM r")
def seq_files(spark, sf_dir):
    at = stored(spark, "seq")
    writers.reads_seq(reads(spark, sf_dir).withColumn("head", F.concat(F.lit("d"), "id")), at)
    return readers.reads(spark, at, "seq", "part-*", partitions=5).select("id", "head", F.md5("seq").alias("seq"))


@query("SELECT doc_id AS id, 'd' || doc_id AS head FROM documents")
def header_files(spark, sf_dir):
    at = stored(spark, "heads")
    writers.reads_parquet(reads(spark, sf_dir).withColumn("head", F.concat(F.lit("d"), "id")), at, compat=True)
    return readers.headers(spark, at, "parquet")


@query(f"WITH {READS} SELECT id, md5(array_to_string(list_filter(string_split(seq, 'N'), lambda x: x <> ''), 'N')) AS seq FROM r")
def base64_files(spark, sf_dir):
    at = stored(spark, "base64")
    writers.reads_base64(reads(spark, sf_dir), at)
    return readers.reads(spark, at, "base64").select("id", F.md5("seq").alias("seq"))


@query(f"WITH {CANONICAL}, {COUNTS} SELECT kmer, cnt FROM c")
def kmer_count_files(spark, sf_dir):
    at = stored(spark, "counts")
    writers.kmer_counts(kmers.counts(features(spark, sf_dir)), at, K)
    return readers.kmer_counts(spark, at, K)


@query(f"WITH {CANONICAL} SELECT count(*) AS n, sum(k) AS total FROM (SELECT kmer, count(*) AS k FROM f GROUP BY kmer HAVING count(*) >= 2)".replace("sum(k)", "CAST(sum(k) AS BIGINT)"))
def index_files(spark, sf_dir):
    at = stored(spark, "index")
    writers.inverted_index(kmers.inverted_index(features(spark, sf_dir), 2, 10**6), at, K)
    return readers.inverted_index(spark, at).agg(F.count("kmer").alias("n"), F.sum(F.size("reads")).cast("long").alias("total"))


@query(f"WITH {ORDERS} SELECT src, dst, w FROM e WHERE w >= 3")
def edge_files(spark, sf_dir):
    at = stored(spark, "edges")
    writers.edges(order_edges(spark, sf_dir), at)
    return readers.edges(spark, at, 3, 20000, partitions=3)


@query(f"WITH RECURSIVE {ORDERS}, {COMPONENTS} SELECT id, label FROM cc")
def cluster_files(spark, sf_dir):
    at = stored(spark, "clusters")
    writers.clusters(clustering.members(clustering.components(order_edges(spark, sf_dir)), 2), at, 4)
    return readers.clusters(spark, at)


@query(f"WITH {READS} SELECT id, md5(seq) AS seq FROM r WHERE id % 7 = 3")
def stored_lookup(spark, sf_dir):
    """Reads in a bucketed table, found by id."""
    name = folder(spark, "x").rsplit("-", 1)[1]
    writers.sequence_store(reads(spark, sf_dir), f"reads_{name}", 8)
    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).where("id % 7 = 3")
    return spark.table(f"reads_{name}").join(wanted, "id").select("id", F.md5("seq").alias("seq"))


@query(f"WITH {READS}, o AS (SELECT id, seq, row_number() OVER (ORDER BY id) - 1 AS k FROM r) SELECT CAST(2 * k AS BIGINT) AS n, md5('>d' || id || chr(10) || seq) AS value FROM o UNION ALL SELECT CAST(2 * k + 1 AS BIGINT), md5('>e' || id || chr(10) || seq) FROM o")
def fastq_interleave(spark, sf_dir):
    sides = [_lines(spark, sf_dir, F.concat(F.lit(f"@{c}"), "id"), F.lower("seq"), F.lit("+"), F.lit("I")) for c in "de"]
    return readers.interleaved(*sides).select("n", F.md5("value").alias("value"))


# The command line, on files.


def order_files(spark: SparkSession, sf_dir: str) -> str:
    at = stored(spark, "orders")
    writers.edges(order_edges(spark, sf_dir), at)
    return at


def tool(spark: SparkSession, *args: str) -> str:
    at = stored(spark, args[0])
    cli.run(spark, cli.parser().parse_args([*args, "-o", at]))
    return at


@query(f"WITH {BOTH}, {COUNTS} SELECT kmer, cnt FROM c")
def cli_kmer_count(spark, sf_dir):
    at = stored(spark, "seq")
    writers.reads_seq(reads(spark, sf_dir).withColumn("head", F.lit("h")), at, codec="gzip")
    return readers.kmer_counts(spark, tool(spark, "kmer-count", "-i", at, "-k", str(K), "--n_iteration", "2", "--codec", "gzip"), K)


@query(f"WITH RECURSIVE {ORDERS}, {COMPONENTS} SELECT id, label FROM cc")
def cli_cc(spark, sf_dir):
    return readers.clusters(spark, tool(spark, "cc", "-i", order_files(spark, sf_dir), "--big_cluster_threshold", "1", "--top_nodes_ratio", "0"))


def clustered(sql: str) -> str:
    """Clusters of two or more under their smallest id, as cluster files name them."""
    return f"SELECT id, min(id) OVER (PARTITION BY label) AS label FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM ({sql})) WHERE n >= 2"


@query(clustered(f"WITH {ORDERS}, {lpa_sql(4, 'edge', True)}"))
def cli_lpa(spark, sf_dir):
    return readers.clusters(spark, tool(spark, "lpa", "-i", order_files(spark, sf_dir), "--weight", "edge", "--max_iteration", "3"))


@query(clustered(f"WITH {ORDERS}, {lpa_sql(3, 'none', False)}"))
def cli_lpa_sync(spark, sf_dir):
    return readers.clusters(spark, tool(spark, "lpa-sync", "-i", order_files(spark, sf_dir), "--max_iteration", "3"))


@query(clustered(f"WITH {ORDERS}, {LOOPED}, {mcl_sql(3)}"))
def cli_mcl(spark, sf_dir):
    return readers.clusters(spark, tool(spark, "mcl", "-i", order_files(spark, sf_dir), "--weight", "edge", "--max_iteration", "3"))


@query(clustered(f"WITH {ORDERS}, {LOOPED}, {ap_sql(3)}"))
def cli_ap(spark, sf_dir):
    return readers.clusters(spark, tool(spark, "ap", "-i", order_files(spark, sf_dir), "--weight", "edge", "--max_iteration", "3", "--convergence_iter", "4"))


@query(f"WITH RECURSIVE {ORDERS}, {COMPONENTS} SELECT 'o' || id AS head, label FROM cc")
def cli_add_seq(spark, sf_dir):
    heads = stored(spark, "seq")
    writers.reads_seq(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("o"), "o_orderkey").alias("head"), F.lit("ACGT").alias("seq")), heads)
    found = tool(spark, "cc", "-i", order_files(spark, sf_dir), "--big_cluster_threshold", "1", "--top_nodes_ratio", "0")
    return spark.read.schema("head string, label long").csv(tool(spark, "add-seq", "-i", found, "--reads", heads), sep="\t")


@query(f"WITH RECURSIVE {ORDERS}, {COMPONENTS} SELECT id, label FROM cc")
def message_loop(spark, sf_dir):
    """Components by message passing: the least id travels until nothing changes."""
    both = edges.symmetric(order_edges(spark, sf_dir).select("src", "dst"))
    both = written(both, "message-edges")
    state = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    return clustering.message_passing(state, both, F.col("label"), F.min("message"), F.least("label", "got"), "label", 100)


@query(f"WITH {ORDERS}, n AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) SELECT CAST((SELECT sum(CASE WHEN n <= 10 THEN n * (n - 1) // 2 ELSE n * least(6, n - 1) END) FROM n) AS BIGINT) AS drawn, 0::BIGINT AS invented")
def ring_draws(spark, sf_dir):
    """What does not depend on the draw: how many pairs all lists give, and that no pair is drawn that shares nothing."""
    drawn = written(edges_sampled_ring(spark, sf_dir), "ring")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("kmer"), F.col("l_orderkey").alias("id")).distinct()
    false = drawn.join(edges.every_shared(rows, 1), ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("invented"))
    return drawn.agg(F.sum("w").cast("long").alias("drawn")).crossJoin(F.broadcast(false))


@query("SELECT true AS known, true AS once, true AS near")
def sample_share(spark, sf_dir):
    """A sample of reads without replacement: only reads of the table, none twice, about the share asked for."""
    at = stored(spark, "seq")
    rows = reads(spark, sf_dir)
    writers.reads_seq(rows.withColumn("head", F.lit("h")), at)
    got, n = written(readers.reads(spark, at, fraction=0.5, seed=3).select("id"), "sample"), rows.count()
    strange = got.join(rows.select("id"), "id", "left_anti").count()
    return got.agg(F.lit(strange == 0).alias("known"), (F.count("id") == F.count_distinct("id")).alias("once"), F.count("id").between(int(0.4 * n), int(0.6 * n)).alias("near"))
