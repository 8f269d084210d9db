"""Sequence overlap of two reads, and edges scored by it.

The score is the longest overlap of at least `min_overlap` bases between a suffix of one read and a prefix of the other
(containment included), on either strand of the second, with at most floor(err_rate * length) mismatches; else 0.

Without mismatches no text moves with an edge. The longer read of an edge is searched for the first and last `min_overlap`
bases of the shorter one's two strands; each place found fixes the overlap's length, and the hash of the longer read's part
goes to the shorter read, which compares it with its own. A read moves twice, whatever the number of its edges. Parts are
equal if their polynomial hashes modulo two primes of 31 bits are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.state import written

_COMPLEMENT = bytes.maketrans(b"ACGT", b"TGCA")
#: Bases that are hashed at once, places that are compared at once, and rows of 32 bytes that a broadcast may hold.
CHUNK, HITS, BROADCAST_ROWS = 1_000_000, 500_000, 1_000_000
_PRIMES, _BASES = (2147483647, 2147483629), (1_270_806_161, 911_382_323)
_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _PRIMES]


def _one_strand(x: np.ndarray, y: np.ndarray, least: int, rate: float) -> int:
    best = 0
    for shift in range(least - len(y), len(x) - least + 1):
        lo, hi = max(0, shift), min(len(x), shift + len(y))
        n = hi - lo
        if n > best and n >= least and np.count_nonzero(x[lo:hi] != y[lo - shift : hi - shift]) <= int(rate * n):
            best = n
    return best


def _exact(x: bytes, y: bytes, least: int) -> int:
    """_one_strand without mismatches: only places where the head of one read is found in the other are compared."""
    best = 0
    for whole, other in ((x, y), (y, x)):
        head = other[:least]
        at = whole.find(head) if len(head) == least else -1
        while at >= 0 and (n := min(len(whole) - at, len(other))) > best:
            if whole[at : at + n] == other[:n]:
                best = n
            at = whole.find(head, at + 1)
    return best


def sequence_overlap(a: str, b: str, min_overlap: int = 31, err_rate: float = 0.0) -> int:
    if min_overlap < 2 or not 0 <= err_rate < 0.5:
        raise ValueError("min_overlap must be over 1 and err_rate in [0, 0.5)")
    if err_rate == 0:
        x, y = a.encode(), b.encode()
        return max(_exact(x, y, min_overlap), _exact(x, y.translate(_COMPLEMENT)[::-1], min_overlap))
    x = np.frombuffer(a.encode(), dtype=np.uint8)
    y, z = (np.frombuffer(s, dtype=np.uint8) for s in (b.encode(), b.encode().translate(_COMPLEMENT)[::-1]))
    return max(_one_strand(x, y, min_overlap, err_rate), _one_strand(x, z, min_overlap, err_rate))


def _reserve(n: int) -> None:
    """Powers of each base and of its inverse for places below n."""
    for own, p, b in zip(_powers, _PRIMES, _BASES, strict=True):
        for i, x in enumerate((b, pow(b, -1, p))):
            while len(own[i]) < n:
                own[i] = np.concatenate([own[i], own[i] * np.uint64(pow(x, len(own[i]), p)) % np.uint64(p)])


class _Texts:
    """Texts in one row, of which any part can be hashed."""

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        _reserve(int(self.size.max(initial=0)) + 1)
        raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
        self.place = np.arange(len(raw) + 1) - np.append(np.repeat(self.start, self.size), len(raw))
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * own[0][self.place[:-1]] % np.uint64(p))]) for own, p in zip(_powers, _PRIMES, strict=True)]

    def half(self, which: int, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hashes by one prime of the n bases from each place of `at`."""
        h, p = self.sums[which], np.uint64(_PRIMES[which])
        return (h[at + n] - h[at]) % p * _powers[which][1][self.place[at]] % p

    def hash(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.half(0, at, n) << np.uint64(32) | self.half(1, at, n)).astype(np.int64)


def _other_strand(text: bytes) -> bytes:
    return text.translate(_COMPLEMENT)[::-1]


def _ends(reads: DataFrame, least: int) -> DataFrame:
    """(id, n, heads, tails): the length of each read, and hashes of the first and last `least` bases, of both strands in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py().encode() for x in batch.column(1)]
            n = np.array([len(t) for t in texts], np.int64)
            long = [t for t in texts if len(t) >= least]
            pieces = _Texts([x for t in long for s in (t, _other_strand(t)) for x in (s[:least], s[-least:])])
            key = pieces.half(0, pieces.start, least).reshape(-1, 2, 2) if long else np.zeros((0, 2, 2), np.uint64)
            both = np.full((len(texts), 2), -1, np.int64)
            both[n >= least] = key[:, 0] << np.uint64(32) | key[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["id", "n", "heads", "tails"])

    return reads.mapInArrow(run, "id long, n long, heads long, tails long")


def _with_texts(reads: DataFrame, rows: DataFrame, key: str, work: Callable[[list[bytes], np.ndarray, dict[str, np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows (long columns) next to the text of the read that `key` names: work gets texts, and for rows the place of their text and their columns."""
    names = [c for c in rows.columns if c != key]
    texts = reads.select(F.col("id").alias(key), "seq", *[F.lit(None).cast("long").alias(c) for c in names])
    both = texts.unionByName(rows.select(key, F.lit(None).cast("string").alias("seq"), *names))
    both = both.repartition(F.col(key)).sortWithinPartitions(key, F.col("seq").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, text = None, b""
        for batch in batches:
            ids, seqs = batch.column(0).to_numpy(), batch.column(1)
            is_row = seqs.is_null().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(~is_row)
            of, wanted = np.cumsum(~is_row)[is_row], np.flatnonzero(is_row)  # 0: the text from the batch before
            columns = {c: batch.column(i + 2).take(pa.array(wanted)).to_numpy() for i, c in enumerate(names)} | {key: ids[wanted]}
            owners = np.concatenate([[-1 if owner is None else owner], ids[at]])
            if len(wanted) and ((of == 0) & (owner is None) | (owners[of] != ids[wanted])).any():
                raise ValueError(f"no read {ids[wanted][owners[of] != ids[wanted]][:1]}")
            used, lo = np.unique(of), 0
            held: list[bytes] = []
            size = 0
            for i, u in enumerate(used.tolist()):
                held.append(text if u == 0 else seqs[at[u - 1]].as_py().encode())
                size += len(held[-1])
                if size >= CHUNK or i == len(used) - 1:
                    a, b = np.searchsorted(of, [used[lo], used[i] + 1])
                    yield from work(held, np.searchsorted(used, of[a:b]) - lo, {c: x[a:b] for c, x in columns.items()})
                    held, size, lo = [], 0, i + 1
            if len(at):
                owner, text = int(ids[at[-1]]), seqs[at[-1]].as_py().encode()

    return both.mapInArrow(run, schema)


def _exact_edges(edges: DataFrame, reads: DataFrame, ends: DataFrame, count: int, least: int) -> DataFrame:
    """overlap_edges without mismatches, for reads of distinct ids; ends are those of `count` reads."""
    side = F.broadcast(ends) if count <= BROADCAST_ROWS else ends
    rows = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).withColumn("edge", F.monotonically_increasing_id())
    for c, n in (("src", "m"), ("dst", "n")):
        rows = rows.join(side.select(F.col("id").alias(c), F.col("n").alias(n), F.col("heads").alias(f"heads_{n}"), F.col("tails").alias(f"tails_{n}")), c, "left")
        rows = rows.withColumn(n, F.coalesce(n, F.raise_error(F.concat(F.lit("no read "), F.col(c))).cast("long")))
    own = F.col("m") >= F.col("n")
    pick = lambda a, b: F.when(own, F.col(a)).otherwise(F.col(b))
    # The length's sign says whether the longer read is src.
    rows = rows.where(F.least("m", "n") >= least).select(
        pick("src", "dst").alias("holder"), pick("dst", "src").alias("other"), F.when(own, F.col("n")).otherwise(-F.col("m")).alias("n"), pick("heads_n", "heads_m").alias("heads"), pick("tails_n", "tails_m").alias("tails"), "edge"
    )

    def search(texts: list[bytes], of: np.ndarray, row: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        held = _Texts(texts)
        at = np.arange(int(held.size.sum()))
        at = at[held.place[:-1] + least <= np.repeat(held.size, held.size)]
        key = held.half(0, at, least) | np.repeat(np.arange(len(texts), dtype=np.uint64), np.maximum(held.size - least + 1, 0)) << np.uint64(31)
        turn = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)
        # kind: 0 and 1 the head and the tail, 2 and 3 those of the other strand
        words = [row[c].astype(np.uint64) >> np.uint64(32) if s == 0 else row[c].astype(np.uint64) & np.uint64(2**32 - 1) for s, c in ((0, "heads"), (0, "tails"), (1, "heads"), (1, "tails"))]
        asked = np.concatenate(words) | np.tile(of.astype(np.uint64) << np.uint64(31), 4)
        likely = np.zeros(1 << 22, bool)
        likely[turn(asked)] = True
        at, key = (x[likely[turn(key)]] for x in (at, key))
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        lo, hi = np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")
        some = np.flatnonzero(hi > lo)
        upto = np.cumsum(hi[some] - lo[some])
        cuts = np.unique(np.append(np.searchsorted(upto, np.arange(0, int(upto[-1]) if len(upto) else 0, HITS)), len(some)))
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = some[i:j]
            count = hi[part] - lo[part]
            ask = np.repeat(part, count)
            p = at[np.repeat(lo[part] - np.cumsum(count) + count, count) + np.arange(len(ask))]
            kind, edge = ask // len(of), ask % len(of)
            first, size = held.start[of[edge]], held.size[of[edge]]
            tail = kind % 2 == 1
            n = np.minimum(np.where(tail, p + least - first, first + size - p), np.abs(row["n"][edge]))
            p = np.where(tail, p + least - n, p)
            once = ~tail | (n < np.abs(row["n"][edge]))  # a whole read is found by its head already
            p, kind, edge, n = p[once], kind[once], edge[once], n[once]
            columns = (row["other"][edge], row["holder"][edge], np.where(row["n"][edge] < 0, kind + 4, kind), n, held.hash(p, n), row["edge"][edge])
            for a in range(0, len(n), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000].astype(np.int64)) for c in columns], names=["other", "holder", "kind", "n", "hash", "edge"])

    def compare(texts: list[bytes], of: np.ndarray, row: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        good = np.zeros(len(of), bool)
        kind_of, n = row["kind"], row["n"]
        kind = kind_of % 4
        for strand in (0, 1):
            pick = np.flatnonzero(kind // 2 == strand)
            if len(pick):
                held = _Texts([_other_strand(t) for t in texts] if strand else texts)
                at = held.start[of[pick]] + np.where(kind[pick] % 2 == 1, held.size[of[pick]] - n[pick], 0)
                good[pick] = held.hash(at, n[pick]) == row["hash"][pick]
        turned = kind_of[good] >= 4
        src, dst = np.where(turned, row["other"][good], row["holder"][good]), np.where(turned, row["holder"][good], row["other"][good])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (src, dst, n[good], row["edge"][good])], names=["src", "dst", "w", "edge"])

    found = _with_texts(reads, rows, "holder", search, "other long, holder long, kind long, n long, hash long, edge long")
    equal = _with_texts(reads, found, "other", compare, "src long, dst long, w long, edge long")
    return equal.groupBy("src", "dst", "edge").agg(F.max("w").alias("w")).drop("edge")


def overlap_edges(edges: DataFrame, reads: DataFrame, min_overlap: int = 31, err_rate: float = 0.0) -> DataFrame:
    """(src, dst, w): edges whose reads overlap, weighted by the score. An edge to an unknown read is an error.

    With mismatches, or where two reads have one id, both texts move with every edge.
    """
    ends = reads.select("id", "seq")
    if err_rate == 0 and min_overlap > 1:
        known = reads.where("id is not null and seq is not null").select(F.col("id").cast("long"), F.col("seq").cast("string"))
        short = written(_ends(known, min_overlap), "overlap-ends")
        count, distinct = short.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
        if count == distinct:
            return _exact_edges(edges, known, short, count, min_overlap)
    rows = edges.select("src", "dst").join(ends.withColumnsRenamed({"id": "src", "seq": "a"}), "src", "left").join(ends.withColumnsRenamed({"id": "dst", "seq": "b"}), "dst", "left")
    rows = rows.withColumn("a", F.coalesce("a", F.raise_error(F.concat(F.lit("no read "), F.col("src"))).cast("string"))).withColumn("b", F.coalesce("b", F.raise_error(F.concat(F.lit("no read "), F.col("dst"))).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst, a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("src", "dst", "a", "b"))
            w = [sequence_overlap(x.as_py(), y.as_py(), min_overlap, err_rate) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([src, dst, pa.array(w, pa.int64())], names=["src", "dst", "w"])

    return rows.mapInArrow(run, "src long, dst long, w long").where("w > 0")
