"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded; filters of widths 2, 3 and 4 slide over a window of 256 bytes; each filter's largest response goes into
a softmax layer. A text is the weighted mean of its windows' logits, all windows of the whole text. Training takes windows at hashed
places of a bounded, hashed sample of labelled rows of each language, cut to mixed lengths so that short texts are met too.

For use, the embedding and filters are multiplied out into tables by byte and by pair of bytes, which gives the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import common

WIDTHS, WINDOW = (2, 3, 4), 256
UNKNOWN = "und"


@dataclass
class ByteNet:
    """embed (256, e); filters by width (w * e, f) with biases; dense (3 f, classes) and bias."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """Per width: responses by pair of bytes (65536, f) and what follows: None, by byte, or by pair."""
        e, out = self.embed.shape[1], []
        for w, kernel in zip(WIDTHS, self.filters, strict=True):
            one = [(self.embed @ kernel[j * e : (j + 1) * e]).astype(np.float32) for j in range(w)]
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
            out.append((pair(one[0], one[1]), None if w == 2 else one[2] if w == 3 else pair(one[2], one[3])))
        return out

    def logits(self, windows: np.ndarray, sizes: np.ndarray, tables: list | None = None) -> np.ndarray:
        """Logits of (n, 256) windows of which the first `sizes` bytes count; the rest is zero."""
        tables = tables or self.tables()
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        short, pooled = np.flatnonzero(sizes < WINDOW), []
        for w, (head, tail), b in zip(WIDTHS, tables, self.biases, strict=True):
            n = WINDOW - w + 1
            response = head.take(pairs[:, :n], axis=0)
            if tail is not None:
                response += tail.take(windows[:, 2 : 2 + n] if w == 3 else pairs[:, 2 : 2 + n], axis=0)
            if len(short):
                place = np.arange(n)[None, :] >= np.maximum(1, sizes[short] - w + 1)[:, None]
                part = response[short]
                part[place] = -np.inf
                response[short] = part
            pooled.append(response.max(axis=1) + b)
        return np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.bias


def train(windows: np.ndarray, sizes: np.ndarray, labels: np.ndarray, langs: list[str], embed: int = 8, filters: int = 16, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 3, least_steps: int = 900) -> ByteNet:
    """Adam on cross entropy. windows (n, 256) uint8, zero behind their sizes; labels index langs.

    Small samples are gone over more often, for `least_steps` steps in all.
    """
    epochs = max(epochs, -(-least_steps * batch // max(1, len(windows))) if len(windows) > batch else epochs)
    rng, k = np.random.default_rng(seed), len(langs)
    params = [rng.normal(0, 0.3, (256, embed))]
    params += [rng.normal(0, (1 / (w * embed)) ** 0.5, (w * embed, filters)) for w in WIDTHS]
    params += [np.zeros(filters) for _ in WIDTHS]
    params += [rng.normal(0, 0.1, (len(WIDTHS) * filters, k)), np.zeros(k)]
    params = [p.astype(np.float32) for p in params]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            x, n, y = windows[rows], sizes[rows], labels[rows]
            e = params[0][x]
            grads, pooled, kept = [np.zeros_like(p) for p in params], [], []
            for i, w in enumerate(WIDTHS):
                cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(rows), WINDOW - w + 1, w * embed)
                response = cols.reshape(-1, w * embed) @ params[1 + i]
                response = response.reshape(len(rows), WINDOW - w + 1, filters)
                response[np.arange(WINDOW - w + 1)[None, :] >= np.maximum(1, n - w + 1)[:, None]] = -1e9
                at = response.argmax(axis=1)
                kept.append((at, cols[np.arange(len(rows))[:, None], at]))
                pooled.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0] + params[4 + i])
            z = np.concatenate(pooled, axis=1)
            h = np.maximum(z, 0)
            out = h @ params[7] + params[8]
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y] -= 1
            p /= len(rows)
            grads[7], grads[8] = h.T @ p, p.sum(axis=0)
            dz = (p @ params[7].T) * (z > 0)
            for i, (w, (at, cols)) in enumerate(zip(WIDTHS, kept, strict=True)):
                d = dz[:, i * filters : (i + 1) * filters]
                grads[1 + i] = np.einsum("bf,bfk->kf", d, cols)
                grads[4 + i] = d.sum(axis=0)
                back = (d[:, :, None] * params[1 + i].T[None]).reshape(len(rows), filters, w, embed)
                for j in range(w):
                    np.add.at(grads[0], x[np.arange(len(rows))[:, None], at + j], back[:, :, j])
            step += 1
            speed = rate * (0.3 if epoch >= epochs - 2 else 1.0)
            for q, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= speed * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return ByteNet(langs, params[0], params[1:4], params[4:7], params[7], params[8])


def windows_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in windows of 256, the last filled up with zeros, and the bytes in each."""
    n = max(1, -(-len(raw) // WINDOW))
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(raw) - WINDOW * (n - 1)
    return np.frombuffer(raw + b"\0" * (n * WINDOW - len(raw)), dtype=np.uint8).reshape(n, WINDOW), sizes


def training_rows(docs: DataFrame, folds: int, held: int, per_lang: int, per_doc: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, windows, sizes and labels of the sample: about per_lang hashed rows a language, per_doc windows a row."""
    fold = common.fold_column(F.col("doc_id").cast("long"), folds)
    pool = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold >= 0) & (fold != held))
    counts = {r.lang: r["count"] for r in pool.groupBy("lang").count().collect()}
    if not counts:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), np.zeros(0, int)
    langs = sorted(counts)
    spot, pick = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(2**31)), F.lit(False)
    for lang, n in counts.items():
        pick = pick | ((F.col("lang") == lang) & (spot < int(2**31 * min(1.0, per_lang / n))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                for k in range(per_doc):
                    h = xxhash.xxh3_64_intdigest(f"{d} {k}".encode())
                    size = (WINDOW, WINDOW, 96, 32)[k % 4]
                    part = raw[(at := h % max(1, len(raw) - size + 1)) : at + size]
                    if part and (k == 0 or len(raw) > size):
                        rows.append((lang, part))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "part"])

    rows = sorted((r.lang, bytes(r.part)) for r in pool.where(pick).transform(common.arrow_map, cut, "lang string, part binary").collect())
    windows, sizes = np.zeros((len(rows), WINDOW), np.uint8), np.zeros(len(rows), int)
    for i, (_, part) in enumerate(rows):
        windows[i, : len(part)] = np.frombuffer(part, dtype=np.uint8)
        sizes[i] = len(part)
    return langs, windows, sizes, np.array([langs.index(r[0]) for r in rows])


def fit(docs: DataFrame, folds: int = 3, held: int = 1, per_lang: int = 1500, per_doc: int = 4) -> ByteNet | None:
    """The network from labelled rows outside the held-out fold; None where there are none."""
    langs, windows, sizes, labels = training_rows(docs, folds, held, per_lang, per_doc)
    return train(windows, sizes, labels, langs) if len(windows) else None


def predict(docs: DataFrame, net: ByteNet | None, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, from its whole text alone.

    Null texts and texts without a letter are "und" with score 0, as is everything where there is no network.
    A null id is not held out. Repeated rows stay; equal texts get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables() if model else []
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                names, scores = [UNKNOWN] * len(keys[lo : lo + 256]), [0.0] * len(keys[lo : lo + 256])
                todo = [(i, t.encode()) for i, t in enumerate(texts[lo : lo + 256].to_pylist()) if model and t and any(map(str.isalpha, t))]
                for i, total in zip((i for i, _ in todo), _documents(model, tables, [r for _, r in todo]), strict=True):
                    p = np.exp(total - total.max())
                    best = int(p.argmax())
                    names[i], scores[i] = model.langs[best], float(p[best] / p.sum())
                ids = keys[lo : lo + 256].to_pylist()
                yield pa.RecordBatch.from_arrays([keys[lo : lo + 256], pa.array([common.fold(d, folds) == held for d in ids]), pa.array(names), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(common.arrow_map, run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, net: ByteNet | None, least: float = 0.35) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a known language with a score of `least` or more."""
    columns, schema = docs.columns, docs.schema
    text = columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables() if model else []
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                todo = [(i, t.encode()) for i, t in enumerate(part.column(text).to_pylist()) if model and t and any(map(str.isalpha, t))]
                keep = [False] * part.num_rows
                for (i, _), total in zip(todo, _documents(model, tables, [r for _, r in todo]), strict=True):
                    p = np.exp(total - total.max())
                    keep[i] = bool(p.max() / p.sum() >= least)
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.transform(common.arrow_map, run, schema)


def _documents(model: ByteNet, tables: list, raws: list[bytes], most: int = 256) -> Iterator[np.ndarray]:
    """The mean logits of each text; windows of many texts go through the network together, at most `most` at once."""
    cut = [windows_of(r) for r in raws]
    if not cut:
        return
    windows, sizes = np.concatenate([w for w, _ in cut]), np.concatenate([s for _, s in cut])
    logits = np.concatenate([model.logits(windows[lo : lo + most], sizes[lo : lo + most], tables) for lo in range(0, len(windows), most)])
    at = 0
    for w, s in cut:
        yield (logits[at : at + len(w)].astype(np.float64) * s[:, None]).sum(axis=0) / s.sum()
        at += len(w)
