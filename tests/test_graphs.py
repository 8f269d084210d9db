"""Edges, clustering, matrices and evaluation, against small plain versions and known results."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import clustering, edges, evaluation, kmers, matrix, overlap
from strandmill.operators.components import connected_components
from strandmill.plans import queries


def graph(spark, rows):
    return spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in rows], "src long, dst long, w long")


@pytest.fixture(scope="module")
def links():
    rng = random.Random(1)
    return sorted({(min(a, b), max(a, b)): rng.randint(2, 9) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(75)) if a != b}.items())


@pytest.fixture(scope="module")
def edge_rows(links):
    return [(a, b, w) for (a, b), w in links]


def plain_components(rows):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b, *_ in rows:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {x: find(x) for x in root}


def plain_lpa(rows, rounds, weight, loops):
    w = {"none": lambda x: 1.0, "edge": float, "logedge": np.log}[weight]
    near = {}
    for a, b, x in rows:
        near.setdefault(a, []).append((b, w(x)))
        near.setdefault(b, []).append((a, w(x)))
    label = {x: x for x in near}
    for _ in range(rounds):
        new = {}
        for x, ys in near.items():
            votes = Counter()
            for y, v in [*ys, *([(x, 1.0)] if loops else [])]:
                votes[label[y]] += v
            new[x] = min(votes, key=lambda k: (-round(votes[k], 6), k))
        label = new
    return label


def as_dict(df, key="id", value="label"):
    return {r[key]: r[value] for r in df.collect()}


def test_components(spark, edge_rows):
    assert as_dict(connected_components(graph(spark, edge_rows)), value="component") == plain_components(edge_rows)
    chain = [(i, i + 1, 1) for i in range(200)]
    random.Random(2).shuffle(chain)
    assert set(as_dict(connected_components(graph(spark, chain)), value="component").values()) == {0}
    odd = spark.createDataFrame([(5, 5), (None, 3), (2, 1), (1, 2)], "src long, dst long")
    assert as_dict(connected_components(odd), value="component") == {5: 5, 1: 1, 2: 1}
    assert connected_components(odd.limit(0)).count() == 0


@pytest.mark.parametrize("weight", ["none", "edge", "logedge"])
def test_label_propagation(spark, edge_rows, weight):
    rows = graph(spark, edge_rows)
    assert as_dict(clustering.lpa(rows, 2, weight)) == plain_lpa(edge_rows, 3, weight, True)
    if weight == "none":
        assert as_dict(clustering.lpa_sync(rows, 3)) == plain_lpa(edge_rows, 3, weight, False)


def test_sync_pairs_swap(spark):
    assert as_dict(clustering.lpa_sync(graph(spark, [(1, 2, 3)]), 3)) == {1: 2, 2: 1}


def test_split_components(spark):
    star = [(0, i, 2) for i in range(1, 8)] + [(1, 2, 2), (3, 4, 2)] + [(20, 21, 2)]
    got = as_dict(clustering.split_components(graph(spark, star), 0.1, 0.5))
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3, 20: 20, 21: 20}


#: A graph of 32 reads in two components.
GOLDEN = """
115,273,3 121,169,2 121,297,2 123,151,4 123,169,6 123,180,6 123,190,4 123,198,6 123,255,7 13,166,20 13,169,3 13,198,2 13,30,2 13,58,28 13,79,8 13,93,20 147,186,2 147,190,2 147,196,3 147,258,2
147,273,2 148,180,2 148,189,6 148,249,6 151,169,8 151,180,4 151,190,4 151,198,8 151,255,4 169,180,6 169,190,6 169,198,14 169,255,7 169,261,2 169,297,3 180,190,8 180,198,6 180,255,10 186,190,6
186,196,8 186,258,2 186,273,4 189,249,6 190,196,6 190,198,7 190,255,8 190,258,4 190,273,12 196,258,2 196,273,4 198,255,6 208,255,16 258,273,4 30,166,2 30,58,2 30,93,2 52,148,5 52,57,2 54,229,7
57,148,2 58,166,20 58,79,8 58,93,20 79,190,6 79,273,6 8,123,4 8,151,4 8,169,4 8,180,4 8,190,5 8,198,4 8,255,4 84,147,2 84,186,8 84,190,6 84,196,8 84,258,2 84,273,4 93,166,20
"""


def test_known_graph(spark):
    rows = graph(spark, [tuple(map(int, e.split(","))) for e in GOLDEN.split()])
    sizes = lambda labels: sorted(Counter(as_dict(labels).values()).values(), reverse=True)
    assert sizes(clustering.components(rows)) == [30, 2]
    assert sizes(clustering.split_components(rows, 0.1, 0.2)) == [6, 6, 5, 5, 3, 2, 2]
    for weight, n, pairs in (("none", 8, 7), ("edge", 6, 4), ("logedge", 7, 4)):
        found = sizes(clustering.lpa(rows, 10, weight))
        assert (len(found), sum(x > 1 for x in found)) == (n, pairs)


def test_edges(spark):
    index = spark.createDataFrame([([1, 2, 3],), ([2, 3],), (list(range(10, 30)),)], "reads array<long>")
    assert {(r.src, r.dst): r.w for r in edges.shared(index, 10, 2).collect()} == {(2, 3): 2}
    ring = edges.shared(index.where(F.size("reads") == 20), 10, 1).collect()
    assert len(ring) == 20 * 6 and all(r.src < r.dst for r in ring)
    rows = graph(spark, [(1, 2, 2), (2, 3, 5), (3, 4, 30000)])
    assert edges.in_range(rows).count() == 2
    assert edges.symmetric(rows).count() == 6 and edges.with_loops(edges.symmetric(rows)).count() == 10
    assert edges.normalized(spark.createDataFrame([(2, 1, 1), (3, 3, 1)], "src long, dst long, w long")).collect()[0][:2] == (1, 2)
    assert {r.id for r in edges.top_degree(edges.degrees(rows), 0.1).collect()} == {2, 3}
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    assert edges.among(rows, nodes).count() == 1 and edges.outside(rows, nodes).count() == 1


def test_exact_overlap_moves_no_text_with_an_edge(spark, monkeypatch):
    rng = random.Random(8)
    bases = ["".join(rng.choice("ACGTN" if rng.random() < 0.02 else "ACGT") for _ in range(rng.randint(0, 60))) for _ in range(12)]
    flip = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    texts = {}
    for i in range(-40, 80):
        x = rng.choice(["A", "AC", "N"]) * rng.randint(0, 30) if rng.random() < 0.2 else rng.choice(bases) + rng.choice(bases)
        x = x[rng.randint(0, 9) : len(x) - rng.randint(0, 9)]
        texts[i] = flip(x) if rng.random() < 0.5 else x
    pairs = [(rng.choice([*texts]), rng.choice([*texts]), 1) for _ in range(3000)]
    pairs += pairs[:50]  # parallel edges stay rows of their own
    rows, reads = spark.createDataFrame(pairs, "src long, dst long, w long").repartition(3), spark.createDataFrame([*texts.items(), (99, None)], "id long, seq string")
    monkeypatch.setattr(overlap, "HITS", 500)
    for least in (2, 12):
        found = overlap.overlap_edges(rows, reads, least)
        want = sorted((a, b, w) for a, b, _ in pairs if (w := overlap.sequence_overlap(texts[a], texts[b], least)))
        assert sorted(map(tuple, found.collect())) == want
    nodes = [found._jdf.queryExecution().optimizedPlan()]
    joins = 0
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().length())]
        if node.nodeName() == "Join":
            joins += 1
            assert "string" not in {node.output().apply(i).dataType().typeName() for i in range(node.output().length())}
    assert joins
    twice = reads.unionByName(spark.createDataFrame([(5, texts[7])], "id long, seq string"))  # ids that stand for two reads
    want = sorted((a, b, w) for a, b, _ in pairs for x in ([texts[a], texts[7]] if a == 5 else [texts[a]]) for y in ([texts[b], texts[7]] if b == 5 else [texts[b]]) if (w := overlap.sequence_overlap(x, y, 12)))
    assert sorted(map(tuple, overlap.overlap_edges(rows, twice, 12).collect())) == want


def test_overlap(spark):
    a, b = "ACGTTGCAACGGATCCATTGACCGGATTAC", "GGATCCATTGACCGGATTACTTTTT"
    assert overlap.sequence_overlap(a, b, 10) == 20
    rc = b[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert overlap.sequence_overlap(a, rc, 10) == 20
    assert overlap.sequence_overlap(a, "T" * 30, 10) == 0
    reads = spark.createDataFrame([(1, a), (2, b), (3, "T" * 30)], "id long, seq string")
    got = overlap.overlap_edges(graph(spark, [(1, 2, 4), (1, 3, 4)]), reads, 10).collect()
    assert [(r.src, r.dst, r.w) for r in got] == [(1, 2, 20)]
    with pytest.raises(Exception, match="no read"):
        overlap.overlap_edges(graph(spark, [(1, 9, 4)]), reads, 10).collect()


def coo(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


def test_matrix(spark):
    rng = np.random.default_rng(0)
    a, b = (np.where(rng.random((9, 9)) < 0.4, rng.integers(1, 9, (9, 9)), 0).astype(float) for _ in range(2))
    x, y = coo(spark, a), coo(spark, b)
    same = lambda df, m: np.allclose(dense(df, m.shape), m)
    assert same(matrix.transposed(x), a.T) and same(matrix.product(x, y), a @ b) and same(matrix.hadamard(x, y), a * b)
    assert same(matrix.plus(x, y), a + b) and matrix.plus(x, x.withColumn("v", -F.col("v"))).count() == 0
    assert same(matrix.divided(x, y), np.divide(a, b, out=np.zeros_like(a), where=b != 0))
    total = a.sum(axis=0)
    assert same(matrix.normalized(x), np.divide(a, total, out=np.zeros_like(a), where=total != 0))
    assert same(matrix.unblocked(matrix.blocked(x, 4, 3), 4, 3), a) and same(matrix.powered(x, 2.0), a**2)
    want = {i: int(np.argmax(np.where(a[i] != 0, a[i], -1))) for i in range(9) if a[i].any()}
    assert as_dict(matrix.row_argmax(x), "i", "j") == want
    assert matrix.totals(x).first().total == a.sum()
    four = spark.createDataFrame([([float(x) for x in (4, 0, 9, 0, 0, 7, 0, 0, 0, 0, 0, 0, 0, 0, 0, 5)],)], "values array<double>")
    m = matrix.from_dense(four, 4)
    assert matrix.to_dense(matrix.transposed(m), 4, 4).first().values == [4, 0, 0, 0, 0, 7, 0, 0, 9, 0, 0, 0, 0, 0, 0, 5]


def test_markov_and_affinity_find_cliques(spark):
    two = [(a, b, 5) for c in (0, 10) for a in range(c, c + 4) for b in range(a + 1, c + 4)] + [(3, 10, 1)]
    got = as_dict(clustering.markov(graph(spark, two), 6))
    assert len({got[x] for x in range(4)} & {got[x] for x in range(10, 14)}) == 0
    got = as_dict(clustering.affinity(graph(spark, two), 8))
    assert set(got) == {0, 1, 2, 3, 10, 11, 12, 13}


def test_evaluation(spark):
    pairs = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 1, "b"), (4, 2, "b"), (5, 2, "b"), (6, 2, "b")], "id long, label long, truth string")
    assert {r.label: round(r.share, 3) for r in evaluation.purity(pairs).collect()} == {1: 0.667, 2: 1.0}
    assert {r.truth: r.share for r in evaluation.completeness(pairs).collect()} == {"b": 0.75}
    assert evaluation.summary(evaluation.purity(pairs)).first().whole == 50
    assert 0 < evaluation.nmi(pairs).first().nmi < 1
    same = pairs.withColumn("truth", F.col("label").cast("string"))
    assert abs(evaluation.nmi(same).first().nmi - 1) < 1e-6


def test_members(spark):
    labels = spark.createDataFrame([(3, 9), (1, 9), (2, 8)], "id long, label long")
    assert [(r.cluster_id, r.members) for r in clustering.members(labels, 2).collect()] == [(1, [1, 3])]
    assert clustering.sized(labels, 2).count() == 2
    assert kmers.in_range(labels.withColumnRenamed("label", "kmer"), 2).count() == 2


def test_order_edges_have_no_cap(spark, tmp_path):
    """A part in 1100 orders, and pairs that share it with a rarer part."""
    rows = [(o, 1) for o in range(1100)] + [(o, 2 + o // 2) for o in range(1100)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.src, r.dst, r.w) for r in queries.edges_orders(spark, str(tmp_path)).collect()}
    assert got == {(o, o + 1, 2) for o in range(0, 1100, 2)}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_count_each_pair_once(spark, block):
    rng = random.Random(block)
    rows = {(rng.randrange(6), rng.randrange(25)) for _ in range(90)} | {(9, None)}
    got = {(r.src, r.dst): r.w for r in edges.every_shared(spark.createDataFrame(sorted(rows, key=str), "kmer long, id long"), 2, block).collect()}
    want = Counter((a, b) for k, a in rows for j, b in rows if k == j and a is not None and b is not None and a < b)
    assert got == {p: n for p, n in want.items() if n >= 2}
