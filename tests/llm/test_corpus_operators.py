"""Mixing, toxicity, language, set joins and the pipeline, on small tables."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandmill.llm import langid, mixing, setjoin, toxicity

SF = "/root/testdata/sf0.001"


def test_mixing(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(400)] + [(7, "x y", "a"), (None, "z", "b"), (8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).documents.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    weight, want, left = dict(zip(["a", "b", "c", None], (5, 2, 1, 5), strict=True)), {}, 1.5 * sum(sizes.values())
    free = set(sizes)
    while True:  # share by weight, stop at twice the size, share the excess again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        free -= over
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 64 for s in sizes)
    again = mixing.mix(docs.repartition(5)).documents
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    assert mixing.mix(docs.limit(0)).documents.count() == 0 and mixing.mix(docs.where("text is null")).documents.first().taken == 0
    shards = mixing.mix(docs, slots=16).slots.groupBy("shard").count().collect()
    assert Counter(r["count"] for r in shards).most_common(1)[0][0] == 16


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000])
def test_permutations(spark, n):
    got = spark.range(n).select(mixing.permute(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))


def plain_components(rows, width=4, num=85, den=100):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets, holds, root = {i: shingles(t) for i, t in rows}, defaultdict(list), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        both = Counter(j for s in sets[i] for j in holds[s])
        for s in sets[i]:
            holds[s].append(i)
        for j, n in both.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(300)]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 12, 15, 18, 25, 40, 80, 150]))]
        for _ in range(rng.choice([2, 4, 40])):
            w = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(w) // 40)])):
                k, way = rng.randrange(len(w)), rng.random()
                if way < 0.4:
                    w[k] = rng.choice(vocabulary)
                elif way < 0.7:
                    w.insert(k, rng.choice(vocabulary))
                elif len(w) > 3:
                    del w[k]
            rows.append((len(rows), " ".join(w)))
    return [*rows, (len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "a b"), (len(rows) + 3, "A  B")]


def test_set_join_equals_brute_force(spark):
    rows = near_copies(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.components(docs).collect()}
    assert got == plain_components(rows)


def test_signatures_meet_wherever_sets_link():
    """Every linked pair shares a signature, sparse segments and prefixes included."""
    rng, schemes = np.random.default_rng(1), setjoin.Schemes(85, 100)
    for _ in range(3000):
        n = int(rng.choice([7, 9, 13, 14, 19, 20, 27, 40, 60, 200]))
        pool = np.unique(rng.integers(0, 2**63, 2 * n + 10, dtype=np.uint64))
        rng.shuffle(pool)
        a = pool[:n]
        cut, more = int(rng.integers(0, n // 8 + 2)), int(rng.integers(0, n // 8 + 2))
        b = np.concatenate([a[cut:], pool[n : n + more]])
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 85 * (len(a) + len(b) - common) and cut + more:
            assert np.intersect1d(schemes.signatures(np.sort(a)), schemes.signatures(np.sort(b))).size


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (5, text + " x"), (9, "other words that stand alone here"), (9, "other words that stand alone here"), (None, text), (11, "")]
    got = setjoin.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["11", "3", "9", "None"]
    assert setjoin.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_joins_pairs_just_above_its_threshold(spark):
    """Scattered edits and one added passage: joined from five-word similarity 0.8 on, kept apart below."""
    words = [f"w{i}" for i in range(304)]  # 300 shingles
    scattered = [f"x{i}" if i in (40, 90, 140, 190, 240, 290) else w for i, w in enumerate(words)]  # 270 common of 330
    rows = [(1, words), (2, scattered), (3, [*words, *(f"y{i}" for i in range(74))]), (4, [*words, *(f"z{i}" for i in range(76))])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [1, 4]


def test_set_join_at_the_pipelines_threshold_equals_brute_force(spark):
    rows = near_copies(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.components(docs, 5, 80, 100).collect()}
    assert got == plain_components(rows, 5, 80, 100)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.fit(docs)
    rows = langid.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 !?", "de"), (None, "the and of", "en"), (4, "x" * 5000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(odd, net).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in net.langs
    assert langid.fit(odd.limit(0)) is None and langid.predict(odd, None).where("lang_pred <> 'und'").count() == 0
    assert langid.accepted(odd, net).where("doc_id in (1, 2, 3)").count() == 0


def test_tables_give_the_filters_sums():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (3, 256), dtype=np.uint8)
    net = langid.train(x, np.array([256, 40, 2]), np.array([0, 1, 0]), ["a", "b"], epochs=1)
    x[1, 40:], x[2, 2:] = 0, 0
    for row, n, got in zip(x, (256, 40, 2), net.logits(x, np.array([256, 40, 2])), strict=True):
        pooled = []
        for w, kernel, b in zip(langid.WIDTHS, net.filters, net.biases, strict=True):
            places = range(max(1, n - w + 1))
            pooled.append(np.max([net.embed[row[i : i + w]].ravel() @ kernel for i in places], axis=0) + b)
        assert np.allclose(np.maximum(np.concatenate(pooled), 0) @ net.dense + net.bias, got, atol=1e-4)


def test_deobfuscation_and_scores(spark):
    rng = random.Random(0)
    plain = ["the", "river", "house", "walked", "around", "morning", "paper", "window", "quiet", "letter"]
    bad = ["idiot", "stupid", "loser", "moron"]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 5 == 0:
            words[3], words[17] = rng.choice(bad), rng.choice(bad)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    for given, want in (("1d10t", "idiot"), ("$tup1d", "stupid"), ("l.o.s.e.r", "loser"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("i d i o t", "idiot")):
        assert scorer.model.restore(given) == want
    got = toxicity.predict(docs, scorer).join(docs.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert got and all(r.predicted == r.toxic for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "the river house $tup1d paper m0r0n"), (None, "the river")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.predict(odd, scorer).collect()} == {1: 0, 2: 0, 3: 1, None: 0}
    assert sorted(str(r.doc_id) for r in toxicity.accepted(odd, scorer).collect()) == ["1", "2", "None"]
    none = toxicity.fit(docs, docs.select("doc_id", "toxic").limit(0))
    assert toxicity.predict(odd, none).agg(F.max("predicted")).first()[0] == 0


@pytest.fixture(scope="module")
def scored(spark):
    """A scorer that knows four toxic words, one of them of three letters."""
    rng = random.Random(1)
    plain = ["the", "river", "house", "walked", "around", "morning", "paper", "window", "quiet", "letter", "a", "i"]
    bad = ["idiot", "stupid", "ignorant", "ass"]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 5 == 0:
            words[3], words[17] = rng.choice(bad), rng.choice(bad)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.fit(docs, docs.select("doc_id", "toxic"))


@pytest.mark.parametrize("word", ["i d i o t", "s t u p i d", "S  T  U  P  I  D", '"i d i o t".', "i d i o t, s t u p i d!", "a s s"])
def test_letters_set_apart_are_scored(spark, scored, word):
    rows = [(1, f"the river house {word} walked around"), (2, "the river house w a l k e d around 1 2 3 4 5 a i"), (3, "a i the 4 5 5 river")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.predict(docs, scored).collect()} == {1: 1, 2: 0, 3: 0}
    assert scored.score(rows[0][1], {}) >= 0.3 > scored.score(rows[1][1], {})


WAYS = ["1diot", "!diot", "idi0t", "id|ot", "idio7", "i9norant", "i6norant", '"$tupid', "[$tupid]", "5tupid,", "a55", "@ss", "ass", "ass,", "(a$s)", "i\u200bd\u00adiot", "i\u200b \u200bd i o t", "s\u200ctupid!", "*diot", "i-d-i-o-t"]


@pytest.mark.parametrize("word", WAYS)
def test_disguises_are_scored(scored, word):
    assert scored.score(f"the river house {word} walked around", {}) >= 0.3


@pytest.mark.parametrize("text", ["(the) river! 455 houses, 1984 paper", "$100 the window's letter; 3.5 a-river @home 2nd", "walked/around (i) letter$ morning!!! hooouse"])
def test_plain_signs_and_numbers_are_no_hits(scored, text):
    assert scored.score(text, {}) < 0.3


def test_long_chunk_is_restored_in_time(scored):
    begin = time.monotonic()
    assert len(scored.model.restore("a1b0c3d.$e" * 10_000)) > 50_000
    assert time.monotonic() - begin < 30


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()}
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == columns and 0.9 * n <= kept.count() <= n
