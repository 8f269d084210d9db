"""The canonical chain: reads, k-mer counts, inverted index without contaminants, edges, clusters, labelled reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators import blocks, clustering, edges, kmers
from strandmill.operators.state import written

METHODS = {"cc": clustering.split_components, "lpa": clustering.lpa, "lpa_sync": clustering.lpa_sync, "mcl": clustering.markov, "ap": clustering.affinity}


def read_edges(reads: DataFrame, k: int = 31, strands: str = "canonical", contamination: float = 5e-5, min_kmer_count: int = 2, max_kmer_count: int = 200, max_degree: int = 100, min_shared: int = 2) -> DataFrame:
    """(src, dst, w) of reads (id, seq)."""
    if strands == "canonical" and k <= 31 and contamination <= 0 and min_kmer_count <= 2 <= max_kmer_count:
        lists = written(blocks.shared_lists(reads, k, max_kmer_count), "kmer-lists")
        # Lists of one first read mostly share more: together, their pairs are summed before they move.
        return edges.shared(lists.repartition(F.element_at("reads", 1)), max_degree, min_shared)
    features = kmers.explode(reads, k, strands)
    contaminants = kmers.top_fraction(kmers.counts(features), contamination) if contamination > 0 else None
    index = kmers.inverted_index(features, min_kmer_count, max_kmer_count, contaminants)
    return edges.shared(index, max_degree, min_shared)


def cluster(weighted: DataFrame, method: str = "lpa", min_size: int = 2, **options) -> DataFrame:
    """(id, label) of clusters of min_size or more."""
    return clustering.sized(METHODS[method](weighted, **options), min_size) if method != "cc" else clustering.split_components(weighted, min_size=min_size, **options)
