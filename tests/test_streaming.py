"""Streamed counts equal batch counts."""

from strandmill.operators import kmers
from strandmill.sources import readers
from strandmill.streaming import reads


def test_running_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, seq in enumerate(["ACGTTGCAACGG", "ACGTTGCANCGG", "TTTTACGTTGCA"]):
        (folder / f"{i}.seq").write_text(f"{i}\th{i}\t{seq}\n")
    stream = reads.running_counts(reads.stream_reads(spark, str(folder), 1), 5)
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    want = kmers.counts(kmers.explode(readers.reads(spark, str(folder)), 5), 1)
    assert sorted(spark.table("counts").collect()) == sorted(want.collect())
