"""Whole texts to token ids with a public tokenizer file, word by word.

The vocabulary used here drops white space and splits text inside white-space chunks only, so a text's ids are
the ids of its chunks in order. Each chunk's ids are kept in a bounded table of the Python worker. Chunks that
are Latin-1 letters, perhaps with a full stop or comma behind, take a shorter pipeline over the same model;
everything else goes through the tokenizer as it is. Columns of texts are split, and their words told apart, by Arrow.
`whole_text` is the plain way that tests compare with.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks a worker remembers before it starts anew (about 200 bytes each).
MEMO = 500_000
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
#: For whole columns: words of Latin-1 letters, and all ASCII marks, which the tokenizer splits off a word as one piece.
LATIN, MARKS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", string.punctuation


class ChunkEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.full = Tokenizer.from_file(path)
        self.words = Tokenizer(self.full.model)
        self.words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.full.get_vocab_size()
        self.ends = np.array([(self.full.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.memo: dict[bytes, bytes] = {}
        self.base: dict[str, bytes] = {}

    def whole_text(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, chunks: list[bytes]) -> None:
        if len(self.memo) + len(chunks) > MEMO:
            self.memo.clear()
            self.base.clear()
        plain, odd = [], []
        for c in chunks:
            s = c.decode()
            m = PLAIN.fullmatch(s)
            (plain.append((c, m[1].lower(), m[2])) if m else odd.append((c, s)))
        new = list({w for _, w, _ in plain}.difference(self.base))
        if new:
            ids = np.array(self.words.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, at = ids.tobytes(), 0
            for w, end in zip(new, (np.flatnonzero(self.ends[ids]) + 1).tolist(), strict=True):
                self.base[w] = raw[4 * at : 4 * end]
                at = end
        for mark in {p for _, _, p in plain if p}.difference(self.base):
            self.base[mark] = self.whole_text(mark)
        for c, w, mark in plain:
            self.memo[c] = self.base[w] + self.base[mark] if mark else self.base[w]
        if odd:
            for (c, _), e in zip(odd, self.full.encode_batch_fast([s for _, s in odd], add_special_tokens=False), strict=True):
                self.memo[c] = np.array(e.ids, dtype="<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        chunks = (text or "").encode().split()
        try:
            return b"".join(map(self.memo.__getitem__, chunks))
        except KeyError:
            seen = set(chunks)
            if len(seen) > MEMO // 2:
                return self.whole_text(text)
            missing = [c for c in seen if c not in self.memo]
            if len(self.memo) + len(missing) > MEMO:
                self.memo.clear()
                self.base.clear()
                missing = list(seen)
            self._learn(missing)
            return b"".join(map(self.memo.__getitem__, chunks))

    def forget(self) -> None:
        """Drop the known words: a Python worker lives on after a task, and would hold them through other operators' stages."""
        self.memo, self.base = {}, {}

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case Latin-1 words."""
        known = list(map(self.base.get, words))
        if None not in known:
            return known
        new = [w for w, x in zip(words, known, strict=True) if x is None]
        if len(self.base) + len(new) > MEMO:
            self.memo.clear()
            self.base.clear()
        ids = np.array(self.words.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        raw = ids.tobytes()
        fresh = dict(zip(new, [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
        self.base.update(fresh)
        return [fresh[w] if x is None else x for w, x in zip(words, known, strict=True)]

    def _others(self, chunks: list[str]) -> list[bytes]:
        """Ids of any chunks, by the tokenizer as it is."""
        keys = [c.encode() for c in chunks]
        known = list(map(self.memo.get, keys))
        new = [c for c, x in zip(chunks, known, strict=True) if x is None]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            self.base.clear()
        fresh = {c: np.array(e.ids, dtype="<u4").tobytes() for c, e in zip(new, self.full.encode_batch_fast(new, add_special_tokens=False), strict=True)}
        self.memo.update((c.encode(), x) for c, x in fresh.items())
        return [fresh[c] if x is None else x for c, x in zip(chunks, known, strict=True)]

    def batch(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of each text, as one call for each gives them; each distinct word of all the texts is looked up once.

        A Latin-1 word and the ASCII marks behind it are pieces of their own to the tokenizer, so they are looked up apart.
        """
        texts = texts.fill_null("")
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        chunks = coded.dictionary
        if len(chunks) > MEMO // 2:  # more than the tables should take at once: halves, or the one text by itself
            if len(texts) < 2:
                return [self(t) for t in texts.to_pylist()]
            half = len(texts) // 2
            return self.batch(texts[:half]) + self.batch(texts[half:])
        word = pc.ascii_rtrim(chunks, characters=MARKS)
        plain = pc.match_substring_regex(word, LATIN)
        word, whole, other = word.filter(plain), chunks.filter(plain), chunks.filter(pc.invert(plain))
        low = pc.utf8_lower(word).dictionary_encode()
        ids = pa.array(self._words(low.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(low.indices)
        sizes = pc.binary_length(word).to_numpy()
        marked = np.flatnonzero(sizes < pc.binary_length(whole).to_numpy())
        marks = [c[n:] for c, n in zip(whole.take(pa.array(marked)).cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), sizes[marked].tolist(), strict=True)]
        ends = dict.fromkeys(marks)
        ends = dict(zip(ends, self._others([m.decode() for m in ends]), strict=True))
        with_marks = pc.binary_join_element_wise(ids.take(pa.array(marked)), pa.array([ends[m] for m in marks], pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        # In one table: words, words with marks, others; and where in it each chunk is.
        table = pa.concat_arrays([ids, with_marks, pa.array(self._others(other.to_pylist()), pa.large_binary())])
        place, is_plain = np.empty(len(chunks), np.int64), plain.to_numpy(zero_copy_only=False)
        own = np.arange(len(ids))
        own[marked] = len(ids) + np.arange(len(marked))
        place[is_plain] = own
        place[~is_plain] = len(ids) + len(marked) + np.arange(len(other))
        joined = table.take(pa.array(place[coded.indices.to_numpy()]))
        _, bounds, data = joined.buffers()
        cuts = np.frombuffer(bounds, np.int64, len(joined) + 1, 8 * joined.offset)[split.offsets.to_numpy()].tolist() if len(joined) else [0] * (len(texts) + 1)
        raw = memoryview(data) if data else b""
        return [bytes(raw[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
