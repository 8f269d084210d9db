"""Token ids in sorted-string-table shards, for binary-search lookup by document.

A shard holds the documents of one key range in key order:

    data block ...   entries (varint shared, varint unshared, varint value bytes, key suffix, value), a restart
                     point every 16 entries, then restart offsets (u32) and their number (u32); zstd, then crc32 (u32)
    block index      one row for each block: varint key bytes, last key, varint offset, size, documents, ids
    Bloom filter     bits, 10 for each document, 7 probes
    footer           offsets and sizes of index and filter, documents, ids, id width, probes, magic (80 bytes)

A key is the 8-byte big-endian id with its sign bit flipped and a 4-byte ordinal among equal ids; a null id has
the empty key and comes first. A value is the document's ids, 2 or 4 bytes each, little-endian.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import common
from strandmill.llm.tokens import encoder

MAGIC = b"STRANDS1"
FOOTER = struct.Struct("<QQQQQQQQ8s8s")
RESTART, BLOCK, BITS, PROBES = 16, 256 * 1024, 10, 7


def key_of(doc_id: int | None, ordinal: int = 0) -> bytes:
    return b"" if doc_id is None else struct.pack(">QI", (doc_id + 2**63) % 2**64, ordinal)


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key[:8])[0] - 2**63


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(doc_id: int | None, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key_of(doc_id)[:8])
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Writes one shard to a binary sink; rows must come in key order."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at = sink, width, 0
        self.index, self.ids = [], []
        self.docs = self.tokens = 0
        self.zip = zstandard.ZstdCompressor(level=1)
        self._new()

    def _new(self) -> None:
        self.block, self.restarts, self.entries, self.block_tokens, self.last = bytearray(), [], 0, 0, b""

    def add(self, doc_id: int | None, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries % RESTART:
            top = min(len(key), len(self.last))
            while shared < top and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.entries += 1
        self.block_tokens += len(value) // self.width
        self.ids.append(doc_id)
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if not self.entries:
            return
        body = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        data = self.zip.compress(body)
        data += struct.pack("<I", zlib.crc32(data))
        self.index.append((self.last, self.at, len(data), self.entries, self.block_tokens))
        self.sink.write(data)
        self.at += len(data)
        self.docs += self.entries
        self.tokens += self.block_tokens
        self._new()

    def close(self) -> None:
        self.flush()
        rows = b"".join(_varint(len(k)) + k + b"".join(map(_varint, rest)) for k, *rest in self.index)
        bits = max(64, BITS * self.docs + 7 & ~7)
        bloom = np.zeros(bits, dtype=bool)
        for d in self.ids:
            bloom[_probes(d, bits)] = True
        filter_ = np.packbits(bloom, bitorder="little").tobytes()
        self.sink.write(rows + filter_ + FOOTER.pack(self.at, len(rows), self.at + len(rows), len(filter_), self.docs, self.tokens, self.width, PROBES, b"\0" * 8, MAGIC))


class Shard:
    """Reads one shard: whole, in key order, or by lookup, which touches the footer, index, filter and one or few blocks."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        foot = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if foot[-1] != MAGIC:
            raise ValueError(f"{uri} is no shard")
        at, n, self.bloom_at, self.bloom_n, self.docs, self.tokens, self.width = foot[:7]
        rows, p, self.blocks = self.file.read_at(n, at), 0, []
        while p < n:
            k, p = _read_varint(rows, p)
            key, p = rows[p : p + k], p + k
            rest = []
            for _ in range(4):
                v, p = _read_varint(rows, p)
                rest.append(v)
            self.blocks.append((key, *rest))
        self.bloom = None

    def close(self) -> None:
        self.file.close()

    def block(self, i: int) -> bytes:
        _, at, n, _, _ = self.blocks[i]
        data = self.file.read_at(n, at)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        return zstandard.ZstdDecompressor().decompress(data[:-4])

    @staticmethod
    def entries(body: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        end = len(body) - 4 * (struct.unpack("<I", body[-4:])[0] + 1)
        key = b""
        while at < end:
            shared, at = _read_varint(body, at)
            unshared, at = _read_varint(body, at)
            n, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + unshared]
            at += unshared
            yield key, body[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self.entries(self.block(i))

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype=f"<u{self.width}").astype("<u4")

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row with this doc_id: filter, binary search of the index, binary search of restart points."""
        if self.bloom is None:
            self.bloom = np.unpackbits(np.frombuffer(self.file.read_at(self.bloom_n, self.bloom_at), dtype=np.uint8), bitorder="little")
        if not self.bloom[_probes(doc_id, len(self.bloom))].all():
            return []
        want, out = key_of(doc_id), []
        for i in range(bisect.bisect_left([b[0] for b in self.blocks], want), len(self.blocks)):
            body = self.block(i)
            count = struct.unpack("<I", body[-4:])[0]
            starts = struct.unpack(f"<{count}I", body[-4 * (count + 1) : -4])
            first = bisect.bisect_left(starts, want, key=lambda s: next(self.entries(body, s))[0])
            for key, value in self.entries(body, starts[max(0, first - 1)]):
                if key[:8] == want[:8]:
                    out.append(self.ids(value))
                elif key > want:
                    return out
        return out


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = 1) -> DataFrame:
    """Write the tokenised docs as shards of ascending doc_id below `folder`, which all executors must reach.

    Returns the manifest: shard, uri, n_docs, n_tokens, first_id, last_id. Each shard is written under a name of its attempt and then
    renamed, so a repeated task replaces a whole file by an equal one. Null text is empty, null ids come first.
    """
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        enc, part = encoder(path), context.partitionId()
        wide = len(enc.ends) > 65536 or end_id > 65535
        name = f"{folder}/shard-{part:07d}.sst"
        writer = out = None
        last, ordinal = object(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if writer is None:
                    store, target = fs.FileSystem.from_uri(name)
                    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(f"{target}.{context.taskAttemptId()}")
                    writer = Writer(out, 4 if wide else 2)
                d, ids = doc_id.as_py(), enc(text.as_py()) + end
                ordinal = ordinal + 1 if d == last else 0
                last = d
                writer.add(d, key_of(d, ordinal), ids if wide else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes())
        if writer is not None:
            writer.close()
            out.close()
            store.move(f"{target}.{context.taskAttemptId()}", target)
            row = [[part], [name], [writer.docs], [writer.tokens], [writer.ids[0]], [writer.ids[-1]]]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["shard", "uri", "n_docs", "n_tokens", "first_id", "last_id"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return common.staged(rows.transform(common.arrow_map, write, "shard long, uri string, n_docs long, n_tokens long, first_id long, last_id long"), "sst-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files.

    Every shard is read by a task of its own, or by one that few share; the number is given, so that small manifests are not merged.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard, at, rows = Shard(uri), base, []
                for key, value in shard:
                    ids = shard.ids(value)
                    rows.append((id_of(key), at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                shard.close()
                if rows:
                    yield _batch(rows)

    base = common.bases(manifest, "shard", "n_tokens", "base")
    rows = manifest.join(common.small(base), "shard").select("uri", "base")
    return rows.repartition(max(1, manifest.count()), F.col("uri")).transform(common.arrow_map, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, tokens) of the wanted ids (a column doc_id), each by binary search in the shards that may hold it.

    The manifest's key ranges (one row for each shard, so as many as there are files) go to the driver and with the tasks; an id
    that a range covers is sent to its shard. Null, repeated and unknown ids are looked up once; unknown ones give no row.
    """
    ranges = manifest.select("first_id", "last_id", "uri").collect()
    low = -(2**63)
    ranges = sorted((low if f is None else f, low if t is None else t, u) for f, t, u in ranges)
    tops = [t for _, t, _ in ranges]

    def shards(d: int) -> list[str]:
        out, i = [], bisect.bisect_left(tops, d)
        while i < len(ranges) and ranges[i][0] <= d:
            out.append(ranges[i][2])
            i += 1
        return out

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, u) for d in batch.column(0).to_pylist() for u in shards(low if d is None else d)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([u for _, u in rows], pa.string())], names=["doc_id", "uri"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = name = None
        for batch in batches:
            found = []
            for d, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if uri != name:
                    shard, name = Shard(uri), uri
                found += [(d, x.tolist()) for x in shard.lookup(d)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "tokens"])

    wanted = ids.select(F.col("doc_id").cast("long")).distinct().transform(common.arrow_map, route, "doc_id long, uri string")
    return wanted.repartition(F.col("uri")).sortWithinPartitions("uri").transform(common.arrow_map, find, "doc_id long, tokens array<long>")
