"""Sequence functions, k-mers and read formats."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions import dna
from strandmill.operators import blocks, edges, kmers, overlap
from strandmill.plans import queries
from strandmill.sources import readers, writers

SEQS = [(1, "ATCGATC"), (2, "ATCG"), (3, "ATCGACGTNACNACTGGTAC"), (4, ""), (5, "NNN")]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def brute(seq, k, strands):
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    out = {p[i : i + k] for p in seq.split("N") for i in range(len(p) - k + 1)}
    return {min(x, rc(x)) for x in out} if strands == "canonical" else out | {rc(x) for x in out} if strands == "both" else out


def dna_rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_reverse_complement_and_canonical(spark):
    assert one(spark, dna.reverse_complement(F.lit("TAAAGAAAACGCTGGAAAACAGCGTGCTGGAA"))) == "TTCCAGCACGCTGTTTTCCAGCGTTTTCTTTA"
    assert one(spark, dna.canonical(F.lit("GCAAAGAAAACGCTGGAAAACAGCGTGCTGG"))) == "CCAGCACGCTGTTTTCCAGCGTTTTCTTTGC"


@pytest.mark.parametrize("seq,bits", [("ATCG", 0b00011011), ("GTCG", 0b11011011), ("TTCG", 0b01011011), ("CTCG", 0b10011011), ("GGGG", 0b11111111), ("AAAA", 0), ("ATC", 0b00011000)])
def test_pack(spark, seq, bits):
    assert bytes(one(spark, dna.pack(F.lit(seq)))) == bytes([bits])
    assert one(spark, dna.unpack(dna.pack(F.lit(seq)), F.lit(len(seq)))) == seq


def test_numbers(spark):
    for v in (0, 1, -1, 2**63 - 1, -(2**63), 258):
        assert one(spark, dna.base64_long(dna.long_base64(F.lit(v)))) == v
    assert one(spark, dna.code(F.lit("G" * 31))) == 4611686018427387903
    assert one(spark, dna.from_code(F.lit(0).cast("long"), 5)) == "AAAAA"
    assert one(spark, dna.argsort(F.array(*map(F.lit, (1, 6, 7, 4, 8, 9, 2, 0, 3, 5))))) == [7, 0, 6, 8, 3, 9, 1, 2, 4, 5]
    assert one(spark, dna.argsort(F.array(*map(F.lit, (1, 6, 7, 4, 8, 9, 2, 0, 3, 5))), True)) == [5, 4, 2, 1, 9, 3, 8, 6, 0, 7]
    assert one(spark, dna.median_of(F.array(F.lit(4), F.lit(1), F.lit(2), F.lit(3)))) == 2.5
    assert len(dna.prefix_groups(4)) == 256


@pytest.mark.parametrize("impl", ["arrow", "expr"])
@pytest.mark.parametrize("strands", ["canonical", "both", "forward"])
@pytest.mark.parametrize("k", [3, 5, 31])
def test_kmers_match_brute_force(spark, impl, strands, k):
    rng = random.Random(k)
    rows = [*SEQS, *[(10 + i, "".join(rng.choice("ACGTACGTACGTN") for _ in range(rng.choice([31, 70, 700])))) for i in range(6)]]
    got = kmers.explode(spark.createDataFrame(rows, "id long, seq string"), k, strands, impl)
    got = got.withColumn("kmer", dna.from_code(F.col("kmer"), k)) if impl == "arrow" else got
    assert {(r.id, r.kmer) for r in got.collect()} == {(i, x) for i, s in rows for x in brute(s, k, strands)}


@pytest.mark.parametrize("k", [5, 12, 31])
def test_blocks_equal_the_long_form(spark, monkeypatch, k):
    monkeypatch.setattr(blocks, "CHUNK", 900)
    rng = random.Random(k)
    part = ["".join(rng.choice("ACGTACGTACGTN") for _ in range(90)) for _ in range(8)]
    seqs = [None, "", "ACGT", *("".join(rng.choice(part) for _ in range(rng.randint(1, 30))) for _ in range(40))]
    seqs += [dna_rc(s) for s in seqs[5:9]]
    reads = spark.createDataFrame([*enumerate(seqs), (7, seqs[9]), (None, seqs[8])], "id long, seq string")
    long = kmers.explode(reads, k).distinct()
    same = lambda a, b: a.exceptAll(b).count() + b.exceptAll(a).count() == 0
    assert kmers.counts(long).count() > 50 and same(kmers.counts(long), blocks.counts(reads, k))
    assert same(kmers.counts(long), blocks.counts(reads, k, passes=2).unionByName(blocks.counts(reads, k, passes=2, turn=1)))
    assert same(kmers.counts(kmers.explode(reads, k, "both").distinct()), blocks.counts(reads, k, "both"))
    assert same(kmers.inverted_index(long, 2, 6), blocks.inverted_index(reads, k, 6))
    assert same(edges.shared(kmers.inverted_index(long, 2, 20), 5), edges.shared(blocks.shared_lists(reads, k, 20), 5))


def test_blocks_move_few_bytes(spark):
    rng = random.Random(1)
    reads = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(5000))) for i in range(100)], "id long, seq string")
    moved = blocks.dealt(reads, 31).selectExpr("sum(octet_length(data))").first()[0]
    assert moved < 2 * 100 * 5000


def test_known_counts(spark):
    rows = spark.createDataFrame(SEQS, "id long, seq string")
    n = lambda i, k: kmers.explode(rows.where(F.col("id") == i), k).count()
    assert n(1, 3) == 2 and n(2, 5) == 0 and n(3, 5) == 8


def test_top_fraction_and_caps(spark):
    counted = spark.createDataFrame([(i, 10 - i // 3) for i in range(12)], "kmer long, cnt long")
    order = [r.kmer for r in kmers.ranked(counted).collect()]
    for c, exact, n in ((0.0, False, 0), (0.1, False, 2), (0.25, False, 4), (0.25, True, 3), (1.0, False, 12)):
        assert {r.kmer for r in kmers.top_fraction(counted, c, exact).collect()} == set(order[:n])
    rows = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(3 if k == 1 else 50)], "kmer long, id long")
    index = {r.kmer: r.reads for r in kmers.inverted_index(rows, 2, 10).collect()}
    assert index[1] == [0, 1, 2] and len(index[2]) == 10 and index[2] == sorted(index[2])
    again = {r.kmer: r.reads for r in kmers.inverted_index(rows.repartition(3), 2, 10).collect()}
    assert again == index
    assert kmers.inverted_index(rows, 2, 10, spark.createDataFrame([(2,)], "kmer long")).count() == 1


def test_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([(7, "h 7", "ACGTNNTTGA"), (8, "h8", "GATTACA")], "id long, head string, seq string")
    writers.reads_seq(rows, str(tmp_path / "s"))
    assert sorted(readers.reads(spark, str(tmp_path / "s")).collect()) == sorted(rows.collect())
    writers.reads_base64(rows, str(tmp_path / "b"))
    assert {r.id: r.seq for r in readers.reads(spark, str(tmp_path / "b"), "base64").collect()} == {7: "ACGTNTTGA", 8: "GATTACA"}
    for compat in (True, False):
        writers.reads_parquet(rows, str(tmp_path / "p"), compat=compat)
        assert sorted(readers.reads(spark, str(tmp_path / "p"), "parquet").collect()) == sorted(rows.collect())
    with pytest.raises(ValueError):
        readers.headers(spark, str(tmp_path / "b"), "base64")


def odd_documents(spark, tmp_path):
    texts = [None, "", "12 #", "qq", "q a q", "Qabcq qdef", "abc" * 400]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return str(tmp_path), con


@pytest.mark.parametrize("name", ["seq_files", "base64_files", "base64_roundtrip"])
def test_files_keep_null_empty_and_baseless_reads(spark, tmp_path, name):
    folder, con = odd_documents(spark, tmp_path)
    got = queries.QUERIES[name](spark, folder)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall(), key=str)


def test_seq_files_keep_odd_headers(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "ACGT"), (2, "", ""), (3, " x ", None), (4, '"', "ACGT")], "id long, head string, seq string")
    writers.reads_seq(rows, str(tmp_path / "s"))
    assert sorted(readers.reads(spark, str(tmp_path / "s")).collect(), key=lambda r: r.id) == rows.collect()


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x 1\nacg\n>y\nttt\n")
    assert [(r.head, r.seq) for r in readers.fasta(spark.read.text(str(tmp_path / "a.fa"))).orderBy("n").collect()] == [("x 1", "ACG"), ("y", "TTT")]
    (tmp_path / "a.fq").write_text("@x\nacg\n+\nIII\n@y\nttt\n+\nIII\n")
    fq = spark.read.text(str(tmp_path / "a.fq"))
    assert [(r.head, r.seq) for r in readers.fastq(fq, paired=True).collect()] == [("x", "ACGNTTT")]
    assert [r.value for r in readers.interleaved(fq, fq).collect()][:2] == [">x\nACG", ">x\nACG"]
    ids = readers.with_ids(readers.fastq(fq)).collect()
    assert [r.id for r in ids] == [0, 1]


def test_exact_overlap_equals_every_shift():
    rng = random.Random(4)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ACGTN" if rng.random() < 0.1 else "AC") for _ in range(rng.randint(0, 14))) for _ in range(2))
        if rng.random() < 0.5 and len(a) > 4:
            b = a[rng.randint(0, 4) :] + b
        least = rng.randint(2, 5)
        x, y, z = (np.frombuffer(s, dtype=np.uint8) for s in (a.encode(), b.encode(), b.encode().translate(overlap._COMPLEMENT)[::-1]))
        assert overlap.sequence_overlap(a, b, least) == max(overlap._one_strand(x, y, least, 0.0), overlap._one_strand(x, z, least, 0.0))


def test_overlap_query_finds_short_overlaps_and_common_kmers(spark, tmp_path):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvwxyz") for _ in range(n))
    shared, copy = word(60), word(50)
    texts = [(1, word(100) + shared), (2, shared + word(100)), *((i, copy) for i in range(3, 33))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.src, r.dst): r.w for r in queries.overlap_edges(spark, str(tmp_path)).collect()}
    assert got[1, 2] == 60 and len(got) == 1 + 30 * 29 // 2 and got[3, 32] == 50
