"""Set join on long signature lists: large groups of near copies, and texts chained by one common passage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import setjoin


def brute(rows, width, num, den):
    """(sizes, components) by the intersections of all pairs."""
    shingles = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        shingles.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    names = {s: i for i, s in enumerate({s for x in shingles for s in x})}
    member = [np.array(sorted(names[s] for s in x), dtype=int) for x in shingles]
    size = np.array([len(x) for x in shingles])
    both = np.zeros((len(rows), len(rows)), dtype=np.float32)
    for lo in range(0, len(names), 8192):
        m = np.zeros((len(rows), 8192), np.float32)
        for i, x in enumerate(member):
            m[i, x[(x >= lo) & (x < lo + 8192)] - lo] = 1
        both += m @ m.T
    linked = (den * both >= num * (size[:, None] + size[None, :] - both)) & (size[:, None] > 0) & (size[None, :] > 0)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        if label[i] != i:
            continue
        todo = [i]
        while todo:
            for j in np.flatnonzero(linked[todo.pop()]).tolist():
                if j != i and label[j] == j:
                    label[j] = i
                    todo.append(j)
    return {rows[i][0]: (int(size[i]), rows[label[i]][0]) for i in range(len(rows))}


def groups(seed, copies=200, chained=200):
    """Near copies of one text that lie up to and beyond the threshold apart, texts that share one licence passage only,
    texts made of passages that many share, and pairs of near copies among them."""
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(60_000)}"
    base, licence = [word() for _ in range(160)], [word() for _ in range(40)]
    passages = [[word() for _ in range(30)] for _ in range(12)]

    def edited(words, n):
        w = words[:]
        for _ in range(n):
            w[rng.randrange(len(w))] = word()
        return w

    for _ in range(copies):
        rows.append(edited(base, rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 9])))
    for _ in range(chained):
        own = [word() for _ in range(rng.choice([30, 90]))]
        rows.append(own + licence)
        if rng.random() < 0.2:
            rows.append(edited(own + licence, 1))
    for _ in range(chained // 2):
        rows.append(sum(rng.sample(passages, 4), []) + [word() for _ in range(rng.choice([0, 5, 20]))])
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize(("width", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_long_lists_equal_brute_force(spark, monkeypatch, width, num, den):
    rows = groups(width)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.components(docs, width, num, den).collect()}
    assert got == brute(rows, width, num, den)
    monkeypatch.setattr(setjoin.rest_pairs, "__defaults__", (16,))  # many blocks on either side
    again = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.components(docs, width, num, den).collect()}
    assert again == got


def test_common_passage_makes_no_pairs(spark):
    """Texts chained by one passage have rare shingles of their own: the second index pairs none of them."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**9)}"
    licence = [word() for _ in range(30)]
    rows = [(i, " ".join([word() for _ in range(60)] + licence)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = setjoin.classes(docs, 4).select("class", "doc_id", F.col("n_shingles").alias("n"))
    assert setjoin.rare_prefixes(docs, sets, 4, 85, 100).count() == 0


def test_few_dear_signatures_need_no_second_index(spark, monkeypatch):
    """Sets of which only a few signatures are common meet all their links in short lists, and are not indexed again."""
    rng, seen = random.Random(4), []
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(6)]
    rows = [(i, " ".join(passage + [word() for _ in range(70)])) for i in range(1500)]
    rows += [(5000 + i, t + " more") for i, t in rows[:5]]
    plain = setjoin.rare_prefixes
    monkeypatch.setattr(setjoin, "rare_prefixes", lambda docs, sets, *a: (seen.append(sets.count()), plain(docs, sets, *a))[1])
    got = setjoin.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80, 100).collect()
    assert sum(seen) <= 15
    assert {r.doc_id: r.component_id for r in got} == {i: i % 5000 for i, _ in rows}


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (50, 100)])
def test_links_meet_in_short_lists_or_both_sets_are_dear(num, den):
    """Whatever signatures are dear: a linked pair shares another one, or either set holds as many dear ones as it says."""
    rng, schemes, open_ = np.random.default_rng(5), setjoin.Schemes(num, den), 0
    for _ in range(4000):
        n = int(rng.choice([7, 9, 13, 14, 19, 20, 27, 40, 60, 69, 86, 200]))
        pool = np.unique(rng.integers(0, 2**63, 3 * n + 10, dtype=np.uint64))
        rng.shuffle(pool)
        most = int(n * (den - num) / num) + 1
        cut, more = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[cut:n], pool[n : n + more]]))
        common = len(np.intersect1d(a, b))
        if not len(b) or den * common < num * (len(a) + len(b) - common) or not cut + more:
            continue
        (x, least_x), (y, least_y) = schemes.signed(a), schemes.signed(b)
        both = np.intersect1d(x, y)
        dear = both[rng.random(len(both)) < rng.choice([0.5, 0.9, 1])]
        if len(dear) < len(both):
            continue
        open_ += 1
        odd = int((dear >= np.uint64(2**63)).sum())
        counts = (len(dear) - odd, odd)
        assert any(counts[k] >= least_x[k] and counts[k] >= least_y[k] for k in (0, 1))
    assert open_ > 200


def test_far_apart_counts_the_highest_bit():
    """Words whose highest bits differ give negative numbers: their bits are those of the words, and never more than the shingles."""
    rng = np.random.default_rng(3)
    words = rng.integers(-(2**63), 2**63, (40, setjoin.BITS // 64), dtype=np.int64)
    words[0] = 0
    words[1] = -1
    want = [[sum((int(a ^ b) % 2**64).bit_count() for a, b in zip(x, y, strict=True)) for y in words] for x in words]
    assert setjoin.far_apart(words, words).tolist() == want
    one = np.unique(rng.integers(0, 2**63, 160, dtype=np.uint64))
    for k in range(1, 24):
        less = setjoin.sketch(one[k:])
        assert setjoin.far_apart(setjoin.sketch(one)[None], less[None])[0, 0] <= k


def test_rest_pairs_meet_in_blocks(spark):
    """All open pairs of a list come out, whatever the blocks, and no others."""
    rng = np.random.default_rng(0)
    core = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([core, rng.integers(0, 2**63, int(k), dtype=np.uint64)])) for k in rng.integers(0, 12, 90)]
    reps = spark.createDataFrame([(i, i, len(x), setjoin.sketch(x).tolist()) for i, x in enumerate(sets)], "class long, doc_id long, n long, sketch array<long>")
    prefixes = spark.createDataFrame([(t, i) for t in (1, 2) for i in range(90)], "token long, class long")
    labels = spark.createDataFrame([(i, 0 if i < 50 else i - i % 2) for i in range(90)], "class long, component long")
    component = {r["class"]: r.component for r in labels.collect()}
    want = set()
    for i in range(90):
        for j in range(i + 1, 90):
            n, m = len(sets[i]), len(sets[j])
            apart = sum((int(x ^ y) % 2**64).bit_count() for x, y in zip(setjoin.sketch(sets[i]), setjoin.sketch(sets[j]), strict=True))
            if component[i] != component[j] and 85 * max(n, m) <= 100 * min(n, m) and 185 * apart <= 15 * (n + m):
                want.add((i, j))
    long = prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    for block in (7, 1000):
        got = setjoin.rest_pairs(prefixes, long, labels, reps, 85, 100, block).collect()
        assert want and {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_forest_spans_components_by_near_pairs():
    rng = np.random.default_rng(3)
    group = rng.integers(0, 30, 200)
    i, j = np.nonzero((group[:, None] != group[None, :]) & (rng.random((200, 200)) < 0.2))
    far = rng.random(len(i))
    kept = setjoin._forest(i, j, group[i], group[j], far)
    assert len(kept) == len(set(group)) - 1  # not all of the thousands of pairs
    root = dict(zip(group, group, strict=True))
    for a, b in zip(group[i[kept]], group[j[kept]], strict=True):
        old, new = root[a], root[b]
        root = {x: new if y == old else y for x, y in root.items()}
    assert len(set(root.values())) == 1
    assert far[kept].mean() < far.mean() / 2
    assert len(setjoin._forest(i[:0], j[:0], i[:0], j[:0], far[:0])) == 0
