"""Jaccard self-join of word-shingle sets by partition of the universe, exact up to 64-bit hashes.

Sizes. Sets with Jaccard similarity of at least J differ in at most H = (1-J)/(1+J) * (|X|+|Y|) shingles. Size bands are wide
by 1/J, so a pair lies in one band or two neighbours. Band k has a scheme of m = H(k) + 1 segments, H(k) for two sets of its
largest size. Each set is signed in the schemes of its own band and of the next one up, so every pair meets in the scheme
of its larger set.

Segments. A scheme hashes every shingle to one of its m segments. Two linked sets differ in fewer shingles than there are
segments, so one segment subset is equal: subsets are indexed by their hash. As m is that of a band's largest sets, smaller ones
agree in more: a set and any linked to it that it meets in a scheme agree in g segments at least, by its size alone.

Allocation. An empty subset would meet every other empty one, at unbounded cost: it is never indexed, and pairs that agree
only in empty segments are paid for by one-deletion neighbourhoods. A set with h < g empty segments is in no such pair. If e <= h
empty segments are all that agree, of the other m - e at least m - 2e + g differ in exactly one shingle; segments with at most one
shingle (c of them) are no use. So a set with h >= g indexes subsets and their one-deletions for its first 3h + c + 1 - g
segments, the cheapest that suffice, and where that is over m also its prefix: the |X| - ceil(J |X|) + 1 shingles of least hash,
one of which a linked set must share.

Cost. A signature's cost is the length of its list. Up to 16 sets give all their pairs. Longer lists are dear. A linked pair that meets
in none but dear lists agrees in g segments that are empty or dear, so either set of it has g - h dear signatures in that scheme (one at
least); a set with fewer has met all that it links with. The others are allocated to a second index, by measured frequency: of the
shingles of all such sets, each set indexes the |X| - ceil(J |X|) + 1 rarest of its own, one of which a linked set must have among its
rarest as well. Texts that
merely share a common passage or licence line have rare shingles of their own, and part here. What still meets in lists
of over 16 sets are mostly near copies of one another: all are compared with one of them, the centre. Those of a list that are not
joined to its largest component then are compared with the whole list, in blocks, by their sketches.

Verification. Parity sketches (2048 bits; the bits that differ are no more than the shingles that differ) drop pairs that
cannot link, and the rest is verified on the texts' sets. Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm import common
from strandmill.llm.common import mix64
from strandmill.operators.components import connected_components

BITS, FULL, BLOCK = 2048, 16, 256
#: Signatures that one task of a join on signatures holds, about.
HELD = 1_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct shingle hashes of a text: ASCII lower case, words between ASCII white space."""

    def __init__(self, width: int):
        self.width, self.memo = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        memo = self.memo
        try:
            ids = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            if len(memo) > 300_000:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            ids = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        n, w = len(ids), min(len(ids), self.width)
        if not n:
            return ids
        code = ids[: n - w + 1].copy()
        for k in range(1, w):
            code = code * GOLDEN + ids[k : n - w + 1 + k]
        return np.unique(mix64(code + np.uint64(w)))


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    h = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return h - 2**64 if h >= 2**63 else h


class Schemes:
    """Bands and segment signatures for a similarity of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def band(self, n: int) -> int:
        k = int(math.log(n) / math.log(self.den / self.num))
        while self.top(k) < n:
            k += 1
        while k and self.top(k - 1) >= n:
            k -= 1
        return k

    def top(self, k: int) -> int:
        """The largest size in band k."""
        return math.floor((self.den / self.num) ** (k + 1) + 1e-9)

    def segments(self, k: int) -> int:
        return 2 * self.top(k) * (self.den - self.num) // (self.den + self.num) + 1

    def prefix(self, n: int) -> int:
        return n - -(-n * self.num // self.den) + 1

    def agreed(self, n: int, k: int) -> int:
        """In how many segments of scheme k a set of size n agrees, at least, with any linked set that it meets there."""
        other = min(self.top(k), n * self.den // self.num)
        return self.segments(k) - (self.den - self.num) * (n + other) // (self.den + self.num)

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """All signatures of a set, as uint64."""
        return self.signed(shingles)[0]

    def signed(self, shingles: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """All signatures of a set, as uint64 (the highest bit says if their scheme is odd), and how many of its even and of its odd scheme's
        must be dear before a linked set can be missed."""
        n = len(shingles)
        if not n:
            return shingles, [1, 1]
        k = self.band(n)
        (own, least), (above, more) = (self._signed(shingles, j) for j in (k, k + 1))
        return np.concatenate([own, above]), [more, least] if k % 2 else [least, more]

    def _signed(self, shingles: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        m = self.segments(k)
        if m == 1:  # no difference is allowed: linked sets are one class
            return shingles[:0], 1
        spread = mix64(shingles + np.uint64(int(GOLDEN) * (k + 1) % 2**64))
        segment = ((spread >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        segment, value = segment[order], mix64(shingles[order])
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        sums, held = np.add.reduceat(value, first), segment[first]
        tag = mix64(held.astype(np.uint64) + np.uint64(k << 32))
        out = [mix64(sums + tag)]
        empty, agreed = m - len(held), self.agreed(len(shingles), k)
        if empty >= agreed:
            counts = np.diff(np.append(first, len(segment)))
            need = 3 * empty + int((counts == 1).sum()) + 1 - agreed
            near = int(np.searchsorted(held, min(need, m)))
            if near:
                end = first[near] if near < len(first) else len(segment)
                which = np.repeat(np.arange(near), counts[:near])
                less = sums[which] - value[:end]
                keep = counts[which] > 1
                out.append(mix64(np.concatenate([sums[:near] + tag[:near], less[keep] + tag[which][keep]]) ^ GOLDEN))
            if need > m:
                out.append(mix64(shingles[: self.prefix(len(shingles))] + np.uint64(k << 32) + np.uint64(77)))
        return np.concatenate(out) >> np.uint64(1) | np.uint64(k % 2 << 63), max(1, agreed - empty)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """32 words of parity bits: how many shingles fall in each of 2048 cells, modulo 2."""
    return np.packbits((np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def classes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, class (null for an empty set or a null id) and parity sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                keys = batch.column(0)[lo : lo + 1000]
                rows = []
                for d, t in zip(keys.to_pylist(), batch.column(1)[lo : lo + 1000], strict=True):
                    s = shingler(t.as_py())
                    use = len(s) and d is not None
                    rows.append((len(s), class_of(s) if use else None, sketch(s) if use else None))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)]], names=["doc_id", "n_shingles", "class", "sketch"])

    return docs.transform(common.arrow_map, run, "doc_id long, n_shingles long, class long, sketch array<long>")


def _lists(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (signature, class) in order, with the length of each one's list and its place there."""
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])])
    sig, cls = sig[fresh], cls[fresh]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(start, len(sig)))
    return sig, cls, np.repeat(size, size), np.arange(len(sig)) - np.repeat(start, size)


def _pairs(cls: np.ndarray, place: np.ndarray) -> np.ndarray:
    """All pairs of classes in one list, of lists that `place` counts through."""
    out = [np.zeros((0, 2), np.int64)]
    for gap in range(1, int(place.max(initial=0)) + 1):
        at = np.flatnonzero(place[gap:] >= gap)
        out.append(np.stack([cls[at], cls[at + gap]], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def _dear(sig: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """(class, even, odd): how many of these signatures a class holds in either kind of scheme."""
    names, at = np.unique(cls, return_inverse=True)
    odd = np.bincount(at[sig < 0], minlength=len(names))
    return np.stack([names, np.bincount(at, minlength=len(names)) - odd, odd], axis=1).astype(np.int64)


def candidates(docs: DataFrame, width: int, num: int, den: int, full: int = FULL, chunk: int = 750_000, shingles: int = 0) -> DataFrame:
    """(a, b): pairs of classes that share a signature held by up to `full` classes; and with b null, the classes a with so many dear
    signatures that linked ones may be missed.

    Tasks first meet signatures among their own rows, so that a signature held by many moves as 17 rows a chunk. `shingles`, the
    number of all sets' shingles, sets the number of tasks that signatures are dealt to, so that each holds about HELD of them. They
    move in blocks, one for each chunk and task.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, schemes, seen = Shingler(width), Schemes(num, den), set()
        sigs, ids, needs, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig, cls, _, place = _lists(np.concatenate(sigs).view(np.int64), np.concatenate(ids))
            more = place > full
            counts, least = _dear(sig[more], cls[more]), np.array(needs, np.int64)
            rows = np.concatenate([np.pad(counts, ((0, 0), (0, 2))), np.insert(least, [1, 1], 0, axis=1)])
            yield from _blocks(sig[~more], cls[~more], rows, parts)

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if d is None:
                    continue
                s = shingler(t.as_py())
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(c)
                got, need = schemes.signed(s)
                sigs.append(got)
                ids.append(np.full(len(got), c, np.int64))
                needs.append((c, *need))
                held += len(got)
                if held >= chunk:
                    yield from flush()
                    sigs, ids, needs, held = [], [], [], 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, ids = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                sig, cls, counts = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.int64, np.uint32), strict=True))
                if len(counts):
                    sigs.append(sig)
                    ids.append(np.repeat(cls, counts))
                else:
                    yield named(sig.reshape(-1, 5), 1)
        if sigs:
            sig, cls, size, place = _lists(np.concatenate(sigs), np.concatenate(ids))
            small = size <= full
            for rows, keys in ((_pairs(cls[small], place[small]), 2), (_dear(sig[~small], cls[~small]), 1)):
                for lo in range(0, len(rows), 100_000):
                    yield named(rows[lo : lo + 100_000], keys)

    def named(rows: np.ndarray, keys: int) -> pa.RecordBatch:
        """Rows of one or two classes and up to four counts."""
        none = pa.nulls(len(rows), pa.int64())
        columns = [pa.array(c) for c in np.ascontiguousarray(rows.T)]
        columns = columns[:keys] + [none] * (2 - keys) + columns[keys:]
        return pa.RecordBatch.from_arrays(columns + [none] * (6 - len(columns)), names=["a", "b", "even", "odd", "least_even", "least_odd"])

    expected = 4 * shingles * den * (den - num) // (num * (den + num))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(min(tasks, expected // (HELD // 16) + 1), expected // HELD)
    rows = docs.transform(common.arrow_map, sign, "part int, sig binary, class binary, counts binary").repartitionById(parts, "part")
    met = rows.transform(common.arrow_map, meet, "a long, b long, even long, odd long, least_even long, least_odd long").groupBy("a", "b")
    met = met.agg(*(F.sum(c).alias(c) for c in ("even", "odd")), *(F.max(c).alias(c) for c in ("least_even", "least_odd")))
    return met.where("b is not null or even >= least_even or odd >= least_odd").select("a", "b")


def _blocks(sig: np.ndarray, cls: np.ndarray, others: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Signatures as one row (part, sig, class, counts) for each of the `parts` tasks that they are dealt to: a class is written once,
    with the number of its signatures there, so a signature takes little more than its 8 bytes. `others`, rows of five numbers, go to any
    task, in the place of signatures and without counts."""
    part = (sig.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((cls, part))
    sig, cls, part = sig[order], cls[order], part[order]
    run = np.flatnonzero(np.concatenate([[True], (cls[1:] != cls[:-1]) | (part[1:] != part[:-1])])) if len(sig) else np.zeros(0, np.int64)
    counts, name, at = np.diff(np.append(run, len(sig))).astype(np.uint32), cls[run], part[run]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(run) else run
    rows = [(int(at[i]), sig[run[i] : run[j] if j < len(run) else len(sig)], name[i:j], counts[i:j]) for i, j in zip(first, np.append(first[1:], len(run)), strict=True)]
    rows += [(int(others[lo, 0] % parts), others[lo : lo + 20_000], name[:0], counts[:0]) for lo in range(0, len(others), 20_000)]
    while rows:
        size, n = 0, 0
        while n < len(rows) and size < common.BATCH_BYTES:
            size, n = size + rows[n][1].nbytes + rows[n][2].nbytes, n + 1
        some, rows = rows[:n], rows[n:]
        columns = [pa.array([r[0] for r in some], pa.int32()), *(pa.array([r[k].tobytes() for r in some], pa.binary()) for k in (1, 2, 3))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "sig", "class", "counts"])


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, class, ...) with the text of each; few ids are broadcast, more are shuffled."""
    return docs.join(common.small(wanted), "doc_id")


def verify(docs: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The linked ones of pairs (a, a_doc, b, b_doc). A set goes to each of its centres; a centre goes to each of its salts."""
    heavy = common.staged(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 128).alias("salts")).where("salts > 1"), "set-centres")
    pairs = pairs.join(common.small(heavy), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))))
    members = pairs.select("a", "salt", F.col("b").alias("class"), F.col("b_doc").alias("doc_id"), F.lit(1).alias("side"))
    centres = pairs.select("a", "salt", F.col("a").alias("class"), F.col("a_doc").alias("doc_id"), F.lit(0).alias("side")).distinct()
    rows = texts_of(docs, common.staged(members.unionByName(centres), "pairs-sides")).select("a", "salt", "class", "side", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, name, centre = Shingler(width), None, None
        for batch in batches:
            out = []
            for a, salt, cls, side, t in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                s = shingler(t.as_py())
                if class_of(s) != cls:
                    continue
                if side == 0:
                    name, centre = (a, salt), s
                elif name == (a, salt):
                    both = len(np.intersect1d(centre, s, assume_unique=True))
                    if den * both >= num * (len(centre) + len(s) - both):
                        out.append((a, cls))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return rows.repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", "side").transform(common.arrow_map, run, "a long, b long")


def rare_prefixes(docs: DataFrame, sets: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(token, class): of each set (class, doc_id), its rarest shingles among all these sets, as many as a linked set must share one of.

    Order is by the number of sets that hold a shingle, then by its hash. Shingles of one set alone come first, and meet nobody.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                got = [(c, s) for c, t in zip(batch.column(0)[lo : lo + 500].to_pylist(), batch.column(1)[lo : lo + 500], strict=True) if class_of(s := shingler(t.as_py())) == c]
                size = [len(s) for _, s in got]
                token = np.concatenate([s for _, s in got]).view(np.int64) if got else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([c for c, _ in got], size).astype(np.int64)), pa.array(np.repeat(size, size).astype(np.int64)), pa.array(token)], names=["class", "n", "token"])

    held = common.staged(texts_of(docs, sets.select("doc_id", "class")).select("class", "text").transform(common.arrow_map, run, "class long, n long, token long"), "set-shingles", "snappy")
    often = held.groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
    own = Window.partitionBy("class")
    rows = held.join(often, "token").withColumn("rank", F.dense_rank().over(own.orderBy("cnt", "token")))
    rows = rows.withColumn("alone", F.col("n") - F.max("rank").over(own))
    out = common.staged(rows.where(f"rank <= n - ceil(n * {num} / {den}) + 1 - alone").select("token", "class").distinct(), "set-prefixes")
    common.discard(held)
    return out


def run_pairs(prefixes: DataFrame, full: int = FULL) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of sets that meet in a list of up to `full`, with stars (centre, member) of longer ones; and the longer ones' tokens."""
    runs = common.staged(prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("centre")).where("n > 1"), "set-runs")
    few = prefixes.join(runs.where(F.col("n") <= full).select("token"), "token").groupBy("token").agg(F.array_sort(F.collect_list("class")).alias("c"))
    later = F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, full), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    pairs = few.select(F.inline(F.flatten(later)))
    long = runs.where(F.col("n") > full)
    stars = prefixes.join(common.small(long), "token").where("class <> centre").select(F.col("centre").alias("a"), F.col("class").alias("b"))
    return pairs.unionByName(stars).distinct(), long


def far_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits differ between each of the sketches x and each of y.

    Bits of signed numbers would be counted on their absolute values, so words are taken as unsigned.
    """
    x, y = x.view(np.uint64), y.view(np.uint64)
    out = np.empty((len(x), len(y)), dtype=np.int32)
    for i, row in enumerate(x):
        out[i] = np.bitwise_count(y ^ row).sum(axis=1, dtype=np.int32)
    return out


def _forest(a: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Of pairs (a, b) of components g and h, `far` apart, those that nearest first join two components that none before did."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    kept = []
    for i in np.lexsort((b, a, far)).tolist():
        x, y = top(int(g[i])), top(int(h[i]))
        if x != y:
            root[x] = y
            kept.append(i)
    return np.array(kept, np.int64)


def rest_pairs(prefixes: DataFrame, long: DataFrame, labels: DataFrame, reps: DataFrame, num: int, den: int, block: int = BLOCK, *, forest: bool = False) -> DataFrame:
    """Pairs (a, b) still open in long lists: of a set outside its list's largest component with any other of another component.

    Either side of a list is dealt into blocks of about `block` sets; sketches of two blocks meet in one task, which returns the
    pairs that sizes and sketches allow. With `forest` a task returns of them the nearest that span its components: fewer than it has
    sets. Once these are verified and joined, most other pairs lie within a component, and a second call gives what is left.
    """
    rows = prefixes.join(common.small(long.select("token", "n")), "token").join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    rows = common.staged(rows, "set-lists")
    parts = common.staged(rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m")), "set-list-parts")
    open_ = parts.groupBy("token").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.sum("m").alias("n"), F.max("m").alias("most"))
    open_ = open_.where("most < n").select("token", "main", F.ceil((F.col("n") - F.col("most")) / block).alias("ps"), F.ceil(F.col("n") / block).alias("qs"))
    rows = rows.select("token", "class", "component").join(common.small(common.staged(open_, "set-open-lists")), "token")
    rows = rows.join(reps.select("class", F.col("n").alias("size"), "sketch"), "class")
    number = lambda salt, n: F.pmod(F.xxhash64("class", F.lit(salt)), F.col(n))
    count = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    left = rows.where("component <> main").withColumn("p", number(1, "ps")).withColumn("q", F.explode(count("qs")))
    right = rows.withColumn("q", number(2, "qs")).withColumn("p", F.explode(count("ps")))
    kept = ["token", "p", "q", "side", "class", "component", "size", "sketch"]
    cells = left.withColumn("side", F.lit(0)).select(*kept).unionByName(right.withColumn("side", F.lit(1)).select(*kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if not (held[0] and held[1]):
                return
            (c, g, n, s), (d, h, m, t) = ([np.array(x) for x in zip(*side, strict=True)] for side in held)
            for lo in range(0, len(c), 256):
                k = slice(lo, lo + 256)
                total = n[k, None] + m[None, :]
                ok = (g[k, None] != h[None, :]) & (num * np.maximum(n[k, None], m[None, :]) <= den * np.minimum(n[k, None], m[None, :]))
                far = far_apart(s[k], t).astype(np.int64)
                ok &= (den + num) * far <= (den - num) * total
                i, j = np.nonzero(ok)
                if forest:
                    near = _forest(c[k][i], d[j], g[k][i], h[j], far[i, j] / total[i, j])
                    i, j = i[near], j[near]
                a, b = c[k][i], d[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = zip(*(c.to_pylist() for c in batch.columns[:7]), strict=True)
            sketches = np.array(batch.column(7).flatten().to_numpy(zero_copy_only=False)).reshape(-1, BITS // 64)
            for (token, p, q, side, cls, component, size), row in zip(keys, sketches, strict=True):
                if (token, p, q) != name:
                    yield from done()
                    name, held = (token, p, q), ([], [])
                held[side].append((cls, component, size, row))
        yield from done()

    met = cells.repartition(F.col("token"), F.col("p"), F.col("q")).sortWithinPartitions("token", "p", "q")
    return met.transform(common.arrow_map, run, "a long, b long").distinct()


def close_pairs(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b) with a document of either set, without those that sizes or sketches rule out."""
    side = lambda x: reps.select(F.col("class").alias(x), F.col("doc_id").alias(f"{x}_doc"), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{num} * greatest(a_n, b_n) <= {den} * least(a_n, b_n)")
    rows = rows.where(f"{den + num} * aggregate(zip_with(a_sketch, b_sketch, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= {den - num} * (a_n + b_n)")
    return rows.select("a", "a_doc", "b", "b_doc")


def verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The linked ones of pairs (a, b) of sets."""
    close = common.staged(close_pairs(pairs, reps, num, den), "set-pairs")
    links = common.staged(verify(docs, close, width, num, den), "set-links")
    common.discard(close)
    return links


def components(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each row of docs (doc_id, text).

    Sets are the distinct `width`-word shingles, or the whole sequence of a shorter text. Two rows link when their sets'
    similarity is at least num / den. Null and empty texts have empty sets and link with nothing; so do null ids, whose
    component_id is null. Rows with equal sets are one class, so copies are never paired. Rows of equal id and different text stay
    rows of their own. Other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = common.staged(classes(docs, width), "set-classes", "snappy")
    reps = common.staged(rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch")), "set-reps", "snappy")
    shingles = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = common.staged(candidates(docs, width, num, den, shingles=shingles), "set-candidates")
    missed, pairs, spent = found.where("b is null").select(F.col("a").alias("class")), found.where("b is not null"), [found]
    dear = missed.limit(1).count()
    if dear:
        sets = common.staged(missed.join(reps, "class").select("class", "doc_id"), "set-dear")
        prefixes = rare_prefixes(docs, sets, width, num, den)
        more, long = run_pairs(prefixes)
        pairs = pairs.unionByName(more).distinct()
        spent += [sets, prefixes]
    links = verified(docs, pairs, reps, width, num, den)
    for forest in (True, True, False) if dear and long.limit(1).count() else ():
        labels = connected_components(links, "a", "b").select(F.col("id").alias("class"), "component")
        links = common.staged(links.unionByName(verified(docs, rest_pairs(prefixes, long, labels, reps, num, den, forest=forest), reps, width, num, den)), "set-links")
    joined = connected_components(links, "a", "b").select(F.col("id").alias("class"), "component")
    common.discard(*spent)
    grouped = reps.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = grouped.select("class", "component").join(least, "component").select("class", "component_id")
    out = rows.select("doc_id", "n_shingles", "class").join(ids, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """docs without near duplicates: of each component only the rows of its smallest doc_id stay, all columns as they are.

    Repeated rows (equal id and text) stay once. Rows of one id and different texts stay if the id does. Rows with null ids stay.
    """
    found = common.staged(components(docs, width, num, den).where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("component_id") == F.col("doc_id")).alias("first")), "set-ids")
    key = F.col("doc_id").cast("long") == F.col("_id")
    gone = found.where("not first").select(F.col("doc_id").alias("_id"))
    rows = docs.join(common.small(gone), key, "left_anti")
    twice = found.where("first and rows > 1").select(F.col("doc_id").alias("_id"))
    if not twice.limit(1).count():
        return rows
    once = rows.join(common.small(twice), key, "left_anti")
    return once.unionByName(rows.join(common.small(twice), key, "left_semi").dropDuplicates(["doc_id", "text"]))
