"""Command line: python -m strandmill.plans.cli TOOL options. Unknown options are errors."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.operators import blocks, clustering, edges, kmers, overlap
from strandmill.operators.state import written
from strandmill.sources import readers, writers

FORMS = ("seq", "parquet", "base64")


def _number(kind, low=None, high=None, above=None, below=None):
    def parse(text: str):
        v = kind(text)
        if low is not None and v < low or high is not None and v > high or above is not None and v <= above or below is not None and v >= below:
            raise argparse.ArgumentTypeError(f"{text} is out of range")
        return v

    return parse


def _io(p, reads: str | None = "-i") -> None:
    if reads:
        p.add_argument(reads, *(["--input"] if reads == "-i" else []), required=True, dest="input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-n", "--n_partition", type=_number(int, 0), default=0)
    p.add_argument("--wait", type=_number(int, 0), default=0, help="seconds to wait at the end")


def _shared(p) -> None:
    p.add_argument("--min_shared_kmers", type=_number(int, 1), default=2)
    p.add_argument("--max_shared_kmers", type=_number(int, 1), default=20000)


def _graph(p, rounds: bool = True) -> None:
    _io(p)
    _shared(p)
    p.add_argument("--n_output_blocks", type=_number(int, 1), default=180)
    p.add_argument("--min_reads_per_cluster", type=_number(int, 0), default=2)
    if rounds:
        p.add_argument("--max_iteration", type=_number(int, 1), default=10)


def _weight(p) -> None:
    p.add_argument("--weight", choices=("none", "edge", "logedge"), default="none")


def _kmer(p) -> None:
    p.add_argument("-p", "--pattern", default="")
    p.add_argument("-C", "--canonical", action="store_true")
    p.add_argument("--format", choices=FORMS, default="seq")
    p.add_argument("-k", type=_number(int, 11), required=True)
    p.add_argument("--n_iteration", type=_number(int, 1), default=1)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandmill", allow_abbrev=False)
    tools = top.add_subparsers(dest="tool", required=True)
    add = lambda name: tools.add_parser(name, allow_abbrev=False)
    p = add("kmer-count")
    _io(p)
    _kmer(p)
    p.add_argument("--codec", choices=("none", "gzip"), default="none", help="compression of the files")
    p = add("kmer-map")
    _io(p, "--reads")
    _kmer(p)
    p.add_argument("--kmer", default="")
    p.add_argument("--use_native", action="store_true", help="no effect: k-mers of up to 31 bases always come from the Arrow kernel")
    p.add_argument("-c", "--contamination", type=_number(float, 0, 1), default=5e-5, help="share of the most frequent k-mers to remove")
    p.add_argument("--min_kmer_count", type=_number(int, 2), default=2)
    p.add_argument("--max_kmer_count", type=_number(int, 2), default=200)
    p = add("edges")
    _io(p)
    p.add_argument("--max_degree", type=_number(int, 1), default=100)
    p.add_argument("--min_shared_kmers", type=_number(int, 1), default=2)
    p.add_argument("--use_native", action="store_true", help="no effect: pairs are always made by expressions")
    p.add_argument("--n_iteration", type=_number(int, 1), default=1)
    p = add("overlap")
    _io(p)
    _shared(p)
    p.add_argument("--db", required=True, help="reads (Parquet)")
    p.add_argument("--min_overlap", type=_number(int, above=1), default=31)
    p.add_argument("--err_rate", type=_number(float, 0, below=0.5), default=0.0)
    p.add_argument("--n_output_blocks", type=_number(int, 0), default=0)
    p = add("cc")
    _graph(p, rounds=False)
    p.add_argument("--top_nodes_ratio", type=_number(float, 0, 1), default=0.1)
    p.add_argument("--big_cluster_threshold", type=_number(float, 0, 1), default=0.2)
    p.add_argument("--use_graphframes", action="store_true", help="no effect: one operator serves both")
    p.add_argument("--n_iteration", type=_number(int, 1), default=1, help="no effect: components need no passes")
    _graph(add("lpa-sync"))
    p = add("lpa")
    _graph(p)
    _weight(p)
    p = add("mcl")
    _graph(p)
    _weight(p)
    p.add_argument("--matrix_block_size", type=_number(int, 0), default=0, help="no effect: entries are rows")
    p.add_argument("--inflation", type=_number(float, above=0), default=2.0)
    p.add_argument("--scaling", type=_number(float, 0), default=1.0)
    p.add_argument("--convergence_iter", type=_number(int, 1), default=0, help="end when labels have stayed for so many rounds; without it all rounds run")
    p = add("ap")
    _graph(p)
    _weight(p)
    p.add_argument("--damping", type=_number(float, 0.5, 1), default=0.5)
    p.add_argument("--scaling", type=_number(float, 0), default=1.0)
    p.add_argument("--convergence_iter", type=_number(int, 1), default=3)
    p = add("add-seq")
    _io(p)
    p.add_argument("--reads", required=True)
    p.add_argument("-p", "--pattern", default="")
    p.add_argument("--format", choices=FORMS, default="seq")
    p.add_argument("--num_output", type=_number(int, 1), default=18)
    for name in ("to-parquet", "to-base64", "add-id"):
        p = add(name)
        _io(p)
        p.add_argument("-p", "--pattern", default="")
        p.add_argument("--coalesce", action="store_true")
    p = add("store")
    _io(p)
    p.add_argument("--compress", action="store_true")
    _io(add("repartition"))
    return top


def passes(n: int, one: Callable[[int], DataFrame]) -> DataFrame:
    """The union of n passes; with more than one, each is run and written before the next, so that only one is in work at a time."""
    if n == 1:
        return one(0)
    parts = [written(one(i), "pass") for i in range(n)]
    return reduce(DataFrame.unionByName, parts)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Runs one tool; returns the clusters written, where it makes clusters, else 0."""
    a, wrote = args, 0
    if a.tool in ("kmer-count", "kmer-map"):
        rows = readers.reads(spark, a.input, a.format, a.pattern, a.n_partition)
        coded = a.k <= 31
        features = kmers.explode(rows, a.k, "canonical" if a.canonical else "both", "arrow" if coded else "expr")
        if a.tool == "kmer-count" and coded:
            strands = "canonical" if a.canonical else "both"
            writers.kmer_counts(passes(a.n_iteration, lambda i: blocks.counts(rows, a.k, strands, a.n_iteration, i)), a.output, a.k, codec=a.codec)
        elif a.tool == "kmer-count":
            writers.kmer_counts(passes(a.n_iteration, lambda i: kmers.counts(kmers.residue(features, a.n_iteration, i))), a.output, a.k, coded)
        else:
            if a.max_kmer_count < a.min_kmer_count:
                raise ValueError("max_kmer_count is below min_kmer_count")
            contaminants = None
            if a.contamination > 0:
                if not a.kmer:
                    raise ValueError("--kmer is required where contamination is over 0")
                named = readers.kmer_counts(spark, a.kmer, a.k)
                contaminants = kmers.top_fraction(named, a.contamination)
                if coded:
                    from strandmill.functions import dna

                    contaminants = contaminants.withColumn("kmer", dna.code(F.col("kmer")))
            writers.inverted_index(passes(a.n_iteration, lambda i: kmers.inverted_index(kmers.residue(features, a.n_iteration, i), a.min_kmer_count, a.max_kmer_count, contaminants)), a.output, a.k, coded)
    elif a.tool == "edges":
        index = readers.inverted_index(spark, a.input)
        writers.edges(passes(a.n_iteration, lambda i: edges.shared(index, a.max_degree, a.min_shared_kmers, passes=a.n_iteration, turn=i)), a.output)
    elif a.tool == "overlap":
        rows = readers.edges(spark, a.input, a.min_shared_kmers, a.max_shared_kmers, a.n_partition)
        found = overlap.overlap_edges(rows, spark.read.parquet(a.db), a.min_overlap, a.err_rate)
        writers.edges(found.repartition(a.n_output_blocks) if a.n_output_blocks else found, a.output)
    elif a.tool in ("cc", "lpa-sync", "lpa", "mcl", "ap"):
        rows = readers.edges(spark, a.input, a.min_shared_kmers, a.max_shared_kmers, a.n_partition)
        least = a.min_reads_per_cluster
        if a.tool == "cc":
            labels = clustering.split_components(rows, a.top_nodes_ratio, a.big_cluster_threshold, least)
            least = 1
        elif a.tool == "lpa-sync":
            labels = clustering.lpa_sync(rows, a.max_iteration)
        elif a.tool == "lpa":
            labels = clustering.lpa(rows, a.max_iteration, a.weight)
        elif a.tool == "mcl":
            labels = clustering.markov(rows, a.max_iteration, a.inflation, a.scaling, a.weight, convergence_rounds=a.convergence_iter)
        else:
            labels = clustering.affinity(rows, a.max_iteration, a.damping, a.scaling, a.convergence_iter, a.weight)
        wrote = writers.clusters(clustering.members(labels, max(1, least)), a.output, a.n_output_blocks)
    elif a.tool == "add-seq":
        writers.labelled_heads(readers.clusters(spark, a.input), readers.headers(spark, a.reads, a.format, a.pattern), a.output, a.num_output)
    elif a.tool == "to-parquet":
        writers.reads_parquet(readers.reads(spark, a.input, "seq", a.pattern), a.output, a.coalesce, compat=True)
    elif a.tool == "to-base64":
        writers.reads_base64(readers.reads(spark, a.input, "seq", a.pattern), a.output, a.coalesce)
    elif a.tool == "add-id":
        rows = spark.read.schema("head string, seq string").option("quote", "").csv(a.input, sep="\t")
        writers.reads_seq(readers.with_ids(rows), a.output, a.coalesce)
    elif a.tool == "store":
        readers.reads(spark, a.input).select("id", "seq").write.mode("overwrite").option("compression", "lz4_raw" if a.compress else "none").parquet(a.output)
    elif a.tool == "repartition":
        writers.repartitioned(spark.read.text(a.input), a.output, max(1, a.n_partition))
    return wrote


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"strandmill {args.tool}").getOrCreate()
    began = time.time()
    wrote = run(spark, args)
    print(f"{args.tool}: {(time.time() - began) / 60:.2f} minutes" + (f", {wrote} clusters" if wrote else ""))
    time.sleep(args.wait)
    return 0


if __name__ == "__main__":
    sys.exit(main())
