"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all texts. Words that look disguised (look-alike digits and signs at any
place beside a letter, letters set apart, letters repeated, characters that do not show) become lattices of readings; Viterbi decoding under the model restores the
likeliest text, and the restored words are scored. All other words have one reading and pass as they are.

The scorer is a lexicon of words and word beginnings, weighted by the lower confidence bound of how toxic the labelled
documents are that hold them, and a logistic regression over a document's strongest hits. It is fitted on a bounded,
hashed sample of labelled rows outside the held-out fold, with the lexicon of one half of the sample judging the other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm import common

#: Fixed readings of look-alike characters.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "×": "x"}
#: A masked letter, and signs that may stand between letters.
MASK, GAPS = "aeiou", ".-_*~'`^,:/\\"
LOOK_COST, DROP_COST, FOLD_COST, MASK_COST, LITERAL_COST, SPLIT_COST = 1.2, 0.8, 0.7, 3.0, 7.0, 1.0
CLASSES = 28
REPEATED = re.compile(r"([^\W\d_])\1\1")
#: Runs of three or more single letters or look-alikes with blanks between them, in quotes or brackets or before punctuation as well.
APART = re.compile(r"(?<![^\s\"'\[{<«“‘(])(?:[\w@$!|+*€£¡(×][ \t]{1,3}){2,}[\w@$!|+*€£¡(×](?=[.,;:!?\"')\]}>»”’…]*(?:\s|\Z))")
EDGES = ".,;:!?\"'()[]{}<>*#%&$«»“”‘’…|-–—_/\\​‌‍"
#: Signs that stand for a letter or between letters, in place of which other readings are tried.
SIGNS = frozenset(LOOKS) | frozenset(GAPS)
#: Punctuation around a word that cannot be part of it.
AROUND = "".join(c for c in EDGES if c not in LOOKS and c != "*")
HIDDEN = re.compile("[\u200b\u200c\u200d\ufeff\u00ad]")
PREFIXES = (4, 5, 6)


def char_class(c: str) -> int:
    """0 for what ends a word, 1 to 26 for a to z, 27 for any other letter."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 if c.isalpha() else 0


class CharModel:
    """Interpolated trigrams over character classes; words stand between double boundaries."""

    def __init__(self, counts: np.ndarray):
        n3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
        p1 = (n1 + 1) / (n1.sum() + CLASSES)
        p2 = (n2 + 4 * p1[None, :]) / (n2.sum(axis=1, keepdims=True) + 4)
        p3 = (n3 + 8 * p2[None, :, :]) / (n3.sum(axis=2, keepdims=True) + 8)
        self.cost = (-np.log(p3)).tolist()

    def restore(self, chunk: str) -> str:
        """The likeliest reading of a disguised chunk; spaces in it may stay word bounds or join letters."""
        chunk = HIDDEN.sub("", chunk).lower().strip()
        lattice, i = [], 0
        while i < len(chunk):
            c, j = chunk[i], i
            while j < len(chunk) and chunk[j] == c:
                j += 1
            n = j - i
            if c.isspace():
                lattice.append([("", 0.0), (" ", SPLIT_COST)])
            elif c.isalpha():
                lattice.append([(c * n, 0.0)] if n < 3 else [(c, FOLD_COST), (c * 2, FOLD_COST + 0.5)])
            else:
                ways = [(r * k, LOOK_COST * k) for r in LOOKS.get(c, "") for k in {1, min(n, 2)}]
                if c == "*":
                    ways += [(m, MASK_COST) for m in MASK]
                if c in GAPS or c == "*":
                    ways.append(("", DROP_COST))
                elif c in "!|+($":
                    ways.append(("", LITERAL_COST / 2))
                lattice.append(ways or [("", DROP_COST)] if not c.isdigit() else [*ways, (c * n, LITERAL_COST)])
            i = j
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for ways in lattice:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, past) in states.items():
                for out, extra in ways:
                    x, y, total = a, b, cost + extra
                    for c in out:
                        k = char_class(c)
                        total += self.cost[x][y][k]
                        x, y = (0, 0) if k == 0 else (y, k)
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, (past, out))
            states = after
        past = min(((cost + self.cost[a][b][0], past) for (a, b), (cost, past) in states.items()), key=lambda s: s[0])[1]
        parts = []
        while past is not None:
            past, out = past
            parts.append(out)
        return "".join(reversed(parts))


def cuts(raw: bytes, table: np.ndarray, size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Parts of raw of about `size` bytes that end where a word ends."""
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw):
            ends = np.flatnonzero(table[np.frombuffer(raw, dtype=np.uint8, count=min(size, len(raw) - end), offset=end)] == 0)
            if len(ends):
                end += int(ends[0])
                break
            end += size
        yield at, min(end, len(raw))
        at = end


def char_counts(docs: DataFrame) -> CharModel:
    """The character model from every text of docs. Each task sums its own texts; at most 28^3 sums reach the driver."""
    table = np.zeros(256, dtype=np.int64)
    for b in range(26):
        table[97 + b] = table[65 + b] = b + 1
    table[128:] = 27

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                raw = "\n".join(t for t in batch.column(0)[lo : lo + 256].to_pylist() if t).encode()
                for at, end in cuts(raw, table):
                    x = table[np.frombuffer(b" " + raw[at:end] + b" ", dtype=np.uint8)]
                    x = x[(x != 0) | np.concatenate([[True], x[:-1] != 0])]
                    x = np.repeat(x, np.where(x == 0, 2, 1))
                    total += np.bincount((x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["code", "n"])

    counts = np.zeros(CLASSES**3, dtype=np.int64)
    for code, n in docs.select(F.col("text").cast("string")).transform(common.arrow_map, run, "code int, n long").groupBy("code").agg(F.sum("n")).collect():
        counts[code] = n
    return CharModel(counts)


def disguised(chunk: str) -> bool:
    """Whether a chunk has readings other than its letters: it holds a letter, and a sign, a repeated run or blanks. Numbers have none."""
    if chunk.isalpha() and not REPEATED.search(chunk):
        return False
    return any(c.isalpha() for c in chunk) and (not SIGNS.isdisjoint(chunk) or len(chunk.split()) > 1 or REPEATED.search(chunk) is not None)


def readings(chunk: str, model: CharModel) -> list[str]:
    """Words a chunk may stand for. Where look-alikes at its edges may be punctuation as well, both readings count."""
    chunk = HIDDEN.sub("", chunk).lower()
    full, bare = chunk.strip(AROUND), chunk.strip(EDGES)
    out = []
    for part in (full, bare) if full != bare else (full,):
        for w in (model.restore(part) if disguised(part) else part).split():
            w = w.strip(EDGES)
            if w and w not in out:
                out.append(w)
    return out


def features(word: str, model: CharModel) -> list[str]:
    """Restored words of one chunk, each with its beginnings (marked by a tilde). A chunk with blanks is a run of letters set apart."""
    out = []
    for w in readings(word, model):
        out.append(w)
        out += [w[:k] + "~" for k in PREFIXES if len(w) > k]
    return out


def chunks_of(text: str | None) -> tuple[set[str], int]:
    """Distinct chunks of a text, with runs of letters set apart taken as one, and the number of chunks."""
    text = text or ""
    if not text.isascii():
        text = HIDDEN.sub("", text)
    words = text.split()
    found = set(words)
    if sum(len(w) == 1 for w in words) >= 2:  # the ends of a run may hold quotes or full stops
        found.update(m[0] for m in APART.finditer(text) if any(c.isalpha() for c in m[0]))
    return found, len(words)


@dataclass
class Scorer:
    model: CharModel
    lexicon: dict[str, float]
    weights: np.ndarray

    def weight(self, chunk: str) -> tuple[float, str]:
        """The strongest entry of a chunk and its first letters, by which hits count as different."""
        best, name = 0.0, ""
        for f in features(chunk, self.model):
            w = self.lexicon.get(f, 0.0)
            if w > best:
                best, name = w, f[:4]
        return best, name

    def vector(self, text: str | None, memo: dict) -> list[float]:
        found, n = chunks_of(text)
        hits: dict[str, float] = {}
        for c in found:
            got = memo.get(c)
            if got is None:
                if len(memo) >= 200_000:
                    memo.clear()
                got = memo[c] = self.weight(c)
            if got[0] and got[0] > hits.get(got[1], 0.0):
                hits[got[1]] = got[0]
        top = sorted(hits.values(), reverse=True)
        strong = sum(w >= 2 for w in top)
        return [1.0, top[0] if top else 0.0, top[1] if len(top) > 1 else 0.0, math.log1p(strong), strong / (1 + n / 200)]

    def score(self, text: str | None, memo: dict) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.vector(text, memo), self.weights), -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column (intercept) is not shrunk."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -2, 2)
    return w


def _lexicon(rows: list[tuple[str, int, int]], least: float = 0.6, z2: float = 2.7) -> dict[str, float]:
    """Log-odds of the lower bound of toxicity, for entries whose bound is at least `least`."""
    out = {}
    for f, toxic, clean in rows:
        n = toxic + clean
        p = toxic / n
        bound = (p + z2 / (2 * n) - math.sqrt(z2 * (p * (1 - p) / n + z2 / (4 * n * n)))) / (1 + z2 / n)
        if bound >= least:
            out[f] = math.log(bound / (1 - bound))
    return out


def bound(toxic: Column, clean: Column, z2: float = 2.7) -> Column:
    """The lower confidence bound of toxic / (toxic + clean), 0 for no rows."""
    n = toxic + clean
    p = toxic / n
    return F.when(n > 0, (p + z2 / (2 * n) - F.sqrt(z2 * (p * (1 - p) / n + z2 / (4 * n * n)))) / (1 + z2 / n)).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, per_label: int = 6000, least: float = 0.6) -> Scorer:
    """The scorer from labels (doc_id, toxic) outside the held-out fold, at most about per_label hashed rows of either label.

    That sample bounds the lexicon as well: of its words and word beginnings, those stay whose confidence bound in the sample or in
    one half of it is `least` or more, for which five toxic rows at least must hold them. Rows of one id and different texts count with the
    text of least hash, so reruns agree.
    Rows with null ids or labels teach nothing; a document labelled twice counts once, as toxic if either says so.
    Without labels of both kinds every score is the share of toxic labels (0 if there are none).
    """
    model = char_counts(docs)
    fold = common.fold_column(F.col("doc_id").cast("long"), folds)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where((fold >= 0) & (fold != held) & F.col("toxic").isin(0, 1))
    known = common.staged(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        share = n.get(1, 0) / max(1, sum(n.values()))
        return Scorer(model, {}, np.array([math.log(max(share, 1e-6) / max(1 - share, 1e-6)), 0, 0, 0, 0]))
    rate = {k: min(1.0, per_label / n[k]) for k in n}
    spot = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(2**31))
    chosen = known.where(((F.col("toxic") == 1) & (spot < int(rate[1] * 2**31))) | ((F.col("toxic") == 0) & (spot < int(rate[0] * 2**31))))
    sample = common.staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(common.small(chosen, 4 * per_label), "doc_id"), "toxic-rows")
    least_hash = F.struct(F.xxhash64("text"), F.col("text"))
    sample = common.staged(sample.groupBy("doc_id", "toxic").agg(F.min_by("text", least_hash).alias("text")), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[Counter] = [Counter() for _ in range(4)]
        memo: dict[str, list[str]] = {}
        for batch in batches:
            for d, text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, _ = chunks_of(text)
                for c in found:
                    if c not in memo:
                        if len(memo) >= 200_000:
                            memo.clear()
                        memo[c] = features(c, model)
                sums[2 * half(d) + toxic].update({f for c in found for f in memo.get(c) or features(c, model)})
        names = list(set().union(*sums))
        for lo in range(0, len(names), 20_000):
            part = names[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([s[f] for f in part], pa.int64()) for s in sums]], names=["feature", "c0", "t0", "c1", "t1"])

    sums = sample.select("doc_id", "text", "toxic").transform(common.arrow_map, count, "feature string, c0 long, t0 long, c1 long, t1 long")
    total = sums.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")]).where("t0 + t1 >= 3 and t0 + t1 > 1.2 * (c0 + c1)")
    t0, t1, c0, c1 = map(F.col, ("t0", "t1", "c0", "c1"))
    rows = total.where(F.greatest(bound(t0, c0), bound(t1, c1), bound(t0 + t1, c0 + c1)) >= least - 1e-9).orderBy("feature").collect()
    scorers = [Scorer(model, _lexicon([(r.feature, r[t], r[c]) for r in rows if r[t]]), np.zeros(5)) for t, c in (("t1", "c1"), ("t0", "c0"))]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: list[dict] = [{}, {}]
        for batch in batches:
            got = [(scorers[half(d)].vector(text, memos[half(d)]), toxic) for d, text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in got], pa.list_(pa.float64())), pa.array([t for _, t in got], pa.int32())], names=["x", "y"])

    seen = sorted((r.y, list(r.x)) for r in sample.select("doc_id", "text", "toxic").transform(common.arrow_map, vectors, "x array<double>, y int").collect())
    if not seen:
        return Scorer(model, {}, np.array([-3.0, 0, 0, 0, 0]))
    w = logistic(np.array([x for _, x in seen]), np.array([y for y, _ in seen], dtype=float))
    w[0] -= math.log(rate[1] / rate[0])
    return Scorer(model, _lexicon([(r.feature, r.t0 + r.t1, r.c0 + r.c1) for r in rows]), w)


def half(doc_id: int) -> int:
    return xxhash.xxh32_intdigest(str(doc_id)) & 1


def predict(docs: DataFrame, scorer: Scorer, folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from the threshold on) of each row, from its whole text alone.

    Null and empty texts get the score of a text without hits. A null id is not held out; repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, memo = shared.value, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                keys = batch.column(0)[lo : lo + 512]
                scores = [use.score(t.as_py(), memo) for t in batch.column(1)[lo : lo + 512]]
                yield pa.RecordBatch.from_arrays([keys, pa.array([common.fold(d, folds) == held for d in keys.to_pylist()]), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(common.arrow_map, run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are and whatever their names, that score below the threshold.

    Null and empty texts score as texts without hits; null ids and repeated rows stay; an empty table gives no rows.
    """
    text, schema = docs.columns.index("text"), docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, memo = shared.value, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield part.filter(pa.array([use.score(t.as_py(), memo) < threshold for t in part.column(text)], pa.bool_()))

    return docs.transform(common.arrow_map, run, schema)
