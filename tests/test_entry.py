"""The driver's entry points and the command line."""

import duckdb
import pytest

import __spark_entry__ as entry
from strandmill.plans import cli

SF = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(x.item() if hasattr(x, "item") else x for x in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", ["reverse_complement", "pack_unpack", "kmer_count_canonical", "kmer_top_fraction", "edges_orders", "cc", "lpa_weighted", "mcl", "affinity_propagation", "mat_mmult", "nmi", "base64_roundtrip", "seq_files", "base64_files", "stored_lookup", "edge_files", "message_loop", "ring_draws", "sample_share", "cli_lpa_sync", "cli_ap"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "lineitem", "orders", "customer", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_command_line_chain(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    a = "ACGTTGCAACGGATCCATTGACCGGATTACGGCATTACCAGT"
    b = "TTGACAACCGGTTCAGGCATCAGGTTTACCGGACCATCAGGA"
    (tmp_path / "r.seq").write_text("".join(f"{i}\th{i}\t{s}\n" for i, s in enumerate([a, a[3:], a[:-4], b, b[2:]])))
    call = lambda *args: cli.run(spark, cli.parser().parse_args(list(args)))
    call("kmer-count", "-i", at("r.seq"), "-o", at("kc"), "-k", "15", "-C")
    call("kmer-map", "--reads", at("r.seq"), "--kmer", at("kc"), "-o", at("km"), "-k", "15", "-C", "-c", "0.01")
    call("edges", "-i", at("km"), "-o", at("e"))
    assert call("cc", "-i", at("e"), "-o", at("cc"), "--big_cluster_threshold", "1") == 2
    # With edge weights the two reads of the second cluster outvote their loops and swap labels round by round: after the rounds and
    # the update at the end they stand alone, and only the first cluster is left. Without weights loops tie, and the least label wins.
    assert call("lpa", "-i", at("e"), "-o", at("lpa"), "--weight", "edge") == 1
    assert call("lpa", "-i", at("e"), "-o", at("lpa"), "--weight", "none") == 2
    call("add-seq", "-i", at("cc"), "--reads", at("r.seq"), "-o", at("heads"))
    got = sorted(r.value for r in spark.read.text(at("heads")).collect())
    assert got == ["h0\t0", "h1\t0", "h2\t0", "h3\t3", "h4\t3"]
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["edges", "-i", "a", "-o", "b", "--max_shared_kmers", "5"])
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["kmer-count", "-i", "a", "-o", "b", "-k", "5"])
