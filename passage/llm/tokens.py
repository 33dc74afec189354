"""Batch encoding with a public tokenizer.

The word tokenizer drops white space and splits before every pre-token, so a
text's ids are those of its units (a run between white space, cut where an
ASCII letter is followed by ASCII punctuation or a digit) put together. The
distinct units of a batch are found by Arrow's dictionary encoding, only
those not met before go to the tokenizer, and numpy lays the ids out.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from passage.llm._common import LOWER, SPACE, utf8

#: Units kept in a worker process; beyond that the memory is emptied and filled anew.
CACHE_UNITS = 700_000

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
for _a, _b in ((0x21, 0x40), (0x5B, 0x60), (0x7B, 0x7E)):
    _MARK[_a:_b + 1] = True


class BatchEncoder:
    """ids of many texts at once. ``special`` marks texts that may hold one of
    the vocabulary's special strings; those are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.ends[i] = piece.endswith("</w>")
        self.known: dict[bytes, bytes] = {}

    def _encode(self, texts: list) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[bytes]) -> None:
        if len(self.known) + len(units) > CACHE_UNITS:
            self.known.clear()
        plain, other = [], []
        for u in units:
            s = u.decode("utf-8")
            (plain if s.rstrip().isalpha() else other).append((u, s))
        for at in range(0, len(plain), 200):
            part = plain[at:at + 200]
            ids = np.array(self._encode([" ".join(s for _, s in part)])[0], np.int32)
            cut = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
            if len(cut) != len(part) or cut[-1] != len(ids):  # a letter whose lower case isn't one pre-token
                other += part
                continue
            begin = 0
            for (u, _), end in zip(part, cut.tolist()):
                self.known[u] = ids[begin:end].tobytes()
                begin = end
        for at in range(0, len(other), 1000):
            part = other[at:at + 1000]
            for (u, _), ids in zip(part, self._encode([s for _, s in part])):
                self.known[u] = np.array(ids, np.int32).tobytes()

    def encode(self, col: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows and the offsets of the rows; ``end_id`` closes every row."""
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        n = len(col)
        raw, off = utf8(col)
        whole = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring(col, "<|"), False))) if n else []
        low = LOWER[raw]
        space = SPACE[low]
        mark = np.zeros(len(low) + 1, bool)
        if len(low):
            mark[1:-1] = (space[:-1] & ~space[1:]) | (_LETTER[low[:-1]] & _MARK[low[1:]])
        mark[off] = True
        pos = np.flatnonzero(mark)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pos) - 1, [None, pa.py_buffer(pos.astype(np.int64)), pa.py_buffer(low)])
        coded = units.dictionary_encode()
        words = coded.dictionary.to_pylist()
        missing = [w for w in words if w not in self.known]
        if missing:
            before = len(self.known)
            self._learn(missing)
            if len(self.known) < before + len(missing):  # the memory was emptied
                self._learn([w for w in words if w not in self.known])
        found = [self.known[w] for w in words]
        sizes = np.array([len(f) >> 2 for f in found], np.int64)
        flat = np.frombuffer(b"".join(found), np.int32)
        at = np.cumsum(sizes) - sizes
        index = np.asarray(coded.indices) if len(units) else np.zeros(0, np.int64)
        count = sizes[index] if len(index) else np.zeros(0, np.int64)
        before = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        ids = flat[np.repeat(at[index] - before[:-1], count) + np.arange(before[-1])] if before[-1] else np.zeros(0, np.int32)
        bounds = before[np.searchsorted(pos, off)]
        if len(whole):
            special = dict(zip(whole.tolist(), self._encode([col[int(i)].as_py() for i in whole])))
            parts = [np.array(special[i], np.int32) if i in special else ids[bounds[i]:bounds[i + 1]] for i in range(n)]
            bounds = np.zeros(n + 1, np.int64)
            np.cumsum([len(p) for p in parts], out=bounds[1:])
            ids = np.concatenate(parts) if n else ids
        if end_id is not None:
            out = np.full(len(ids) + n, end_id, np.int32)
            keep = np.ones(len(out), bool)
            keep[bounds[1:] + np.arange(n)] = False
            out[keep] = ids
            ids, bounds = out, bounds + np.arange(n + 1)
        return ids, bounds


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """The worker process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]


def word_tokenizer() -> str:
    """Path of the public word tokenizer on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
