"""Ties, repeated rows, long texts and clashing columns of the training-data operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import audio, common, langid, mixing, quality, setjoin, toxicity


def labelled(spark, rng, repeats):
    plain, bad = ["the", "river", "house", "walked", "morning", "paper", "window"], ["idiot", "stupid", "moron"]
    rows = []
    for i in range(300):
        for _ in range(repeats):
            rows.append((i, " ".join([rng.choice(plain) for _ in range(20)] + ([rng.choice(bad)] if i % 3 == 0 else [])), int(i % 3 == 0), "clash", 0.0))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, predicted string, score double")


def test_fit_on_repeated_ids_is_repeatable(spark):
    docs = labelled(spark, random.Random(3), 3)
    first, second = (toxicity.fit(d, d.select("doc_id", "toxic")) for d in (docs.repartition(2), docs.repartition(5).orderBy(F.rand(1))))
    assert first.lexicon == second.lexicon and first.lexicon and np.array_equal(first.weights, second.weights)
    assert toxicity.predict(docs, first).columns == ["doc_id", "held_out", "score", "predicted"]
    kept = toxicity.accepted(docs, first)
    assert kept.columns == docs.columns and kept.where("toxic = 1").count() == 0 and toxicity.accepted(docs.limit(0), first).count() == 0
    long = spark.createDataFrame([(1, "river house " * 300_000 + "$tup1d i d i o t"), (2, "river house " * 300_000)], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.predict(long, first).collect()} == {1: 1, 2: 0}


def test_lexicon_bound_in_sql_is_the_lexicons(spark):
    pairs = [(t, c) for t in range(9) for c in range(9) if t + c]
    got = spark.createDataFrame(pairs, "t long, c long").select("t", "c", toxicity.bound(F.col("t"), F.col("c")).alias("b")).collect()
    for r in got:
        lexicon = toxicity._lexicon([("x", r.t, r.c)], least=1e-9)
        assert (r.b < 1e-8 and not lexicon) or abs(math.log(r.b / (1 - r.b)) - lexicon["x"]) < 1e-6


def test_cuts_end_with_words():
    table = np.zeros(256, dtype=np.int64)
    table[97:123] = 1
    raw = b"abc de fgh " + b"x" * 50 + b" yz q"
    for size in (1, 2, 3, 7, 100):
        parts = list(toxicity.cuts(raw, table, size))
        assert b"".join(raw[a:b] for a, b in parts) == raw and all(b == len(raw) or raw[b : b + 1] == b" " for _, b in parts)


def test_resampling_is_the_filters_sum():
    x = np.random.default_rng(0).integers(-30000, 30000, 400).astype(np.int16)
    for rate, to in ((8000, 16000), (8000, 6000), (8000, 11025), (16000, 8000)):
        g = math.gcd(rate, to)
        up, down = to // g, rate // g
        taps, padded = audio._filters(up, down), np.concatenate([np.zeros(7), x.astype(float), np.zeros(9)])
        want = [sum(padded[k * down // up + j] * taps[k * down % up][j] for j in range(16)) for k in range(-(-len(x) * up // down))]
        got = audio.resample(x, rate, to)
        exact = np.clip(want, -32768, 32767)
        keep = [k * down % up != 0 or up < down for k in range(len(want))]  # other samples are the given ones
        assert len(got) == len(want) and np.abs(got - exact)[keep].max() <= 1


def test_pcm_is_stored_and_read_back(spark):
    rows = [(1, "some text"), (2, None), (3, "long text, many words " * 20_000), (None, "x"), (3, "long text, many words " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    stored = common.staged(audio.expand(common.staged(audio.store(docs), "audio")), "pcm")
    got = {r.doc_id: r for r in stored.select("doc_id", "n_bytes", "n_samples", F.length("pcm").alias("bytes"), F.crc32("pcm").alias("crc"), "feature").collect()}
    assert len(got) == 4 and stored.count() == 5
    for d, t in rows:
        assert got[d].n_bytes == len((t or "").encode()) and got[d].bytes == 2 * got[d].n_samples and got[d].feature.endswith(f"|{got[d].crc}")


def test_copies_of_odd_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (4, None, "y"), (5, "", None)] + [(10 + i, "w " * (i % 40), "xyz"[i % 3]) for i in range(120)]
    docs = spark.createDataFrame([(*r, 7, "c") for r in rows], "doc_id long, text string, source string, size int, taken string")
    got = mixing.copies(docs)
    assert got.columns == docs.columns
    n = {}
    for r in got.collect():
        n[str(r)] = n.get(str(r), 0) + 1
    assert all(k <= 4 for k in n.values()) and {str(r) for r in docs.where("doc_id in (4, 5)").collect()} <= n.keys()
    assert sorted(map(str, mixing.copies(docs.repartition(7)).collect())) == sorted(map(str, got.collect()))
    assert mixing.copies(docs.limit(0)).count() == 0


def test_one_long_document_mixes(spark):
    docs = spark.createDataFrame([(1, "w " * 500_000, "a"), (2, "x y", "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs).documents.collect()}
    assert got[1].size == 500_000 and abs(got[1].taken - got[1].target) <= 128 and got[2].taken == 4


def test_set_join_of_odd_rows(spark):
    long = " ".join(f"w{i % 5000}x{i % 7}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, "a b"), (3, "other words of the same id, which are not alike"), (None, long), (5, None), (6, "A  B")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, class string, n_shingles int")
    got = sorted((str(r.doc_id), r.component_id) for r in setjoin.components(docs).collect())
    assert got == sorted([("1", 1), ("2", 1), ("3", 3), ("3", 3), ("None", None), ("5", 5), ("6", 3)])
    kept = setjoin.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "5", "None"]


def test_languages_of_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    net = langid.fit(docs)
    assert langid.predict(docs, net).columns == ["doc_id", "held_out", "lang_pred", "score"]
    kept = langid.accepted(docs, net)
    assert kept.columns == docs.columns and langid.accepted(docs.limit(0), net).count() == 0


@pytest.mark.parametrize(("line", "rule"), [("Alle Rechte vorbehalten.", "boilerplate"), ("Tous droits réservés par le site", "boilerplate"), ("Todos los derechos reservados.", "boilerplate"), ("Zur Startseite und mehr lesen", "navigation"), ("Lire la suite de cet article", "navigation"), ("Volver arriba o leer más", "navigation")])
def test_phrases_in_four_languages(line, rule):
    assert quality.line_fails(line) == rule


def test_line_rules_equal_plain_counts():
    rng = random.Random(1)
    for _ in range(60):
        lines = [" ".join(rng.choice(["a", "b#", "c", "d|", "é"]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 30))]
        text = "\n".join(lines)
        got = quality.judge(text)
        words = text.split()
        seen, dup = set(), 0
        for x in lines:
            if x.strip():
                dup += x in seen
                seen.add(x)
        spots = {}
        for i in range(len(words) - 2):
            spots.setdefault(tuple(words[i : i + 3]), []).append(i)
        repeats = len({i + k for v in spots.values() if len(v) > 1 for i in v for k in range(3)})
        assert got[:6] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeats, len(words) < 50 or 100 * repeats > 50 * len(words))
        lost = sum(len("".join(x.split())) for x in lines if x.strip() and quality.line_fails(x))
        assert got[6] == (not got[5] and lost <= 0.4 * sum(map(len, words)))
