"""Batch encoding with a public byte-level tokenizer.

Its pre-tokens never reach over the end of a word into white space, nor from
an ASCII letter into a digit or sign. So a text is cut before every run of
ASCII white space that follows something else (but not behind other Unicode
white space, with which the run forms one pre-token) and between an ASCII
letter and a digit or sign. The distinct units of a batch are found by Arrow's
dictionary encoding, and only those not met before go to the tokenizer: many
at once, put together, as a unit that starts with white space can't merge
with the one before it. Texts that may hold the vocabulary's special string
are encoded whole. Long texts need no more memory than their units and ids.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from passage.llm._common import SPACE, utf8

#: Bytes of units and their ids kept in a worker process; beyond that the memory is emptied.
CACHE_BYTES = 112 << 20
#: What an entry takes beside its bytes and ids.
ENTRY_BYTES = 150
#: Units encoded as one string.
JOINED = 400

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x7F] = True
_SIGN &= ~_LETTER


def _after_wide_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places follow a white-space character beyond ASCII (fixed values of Unicode)."""
    a, b, c = (raw[np.maximum(at - k, 0)].astype(np.int64) for k in (1, 2, 3))
    code = np.where(c >= 0xE0, (c & 15) << 12 | (b & 63) << 6 | (a & 63), 0)
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0)) & (at > 1)
    three = (at > 2) & ((code == 0x1680) | ((code >= 0x2000) & (code <= 0x200A)) | (code == 0x2028) | (code == 0x2029) | (code == 0x202F) | (code == 0x205F) | (code == 0x3000))
    return (a >= 0x80) & (two | three)


class ByteEncoder:
    """ids of many texts at once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.sizes = np.zeros(self.vocab_size, np.int64)  # a byte-level piece has a character a byte
        for piece, i in vocab.items():
            self.sizes[i] = len(piece)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known, self.held = {}, 0                                      # the number of each unit known
        self.at, self.n, self.flat = (np.zeros(0, t) for t in (np.int64, np.int32, np.int32))  # and their ids

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: pa.LargeBinaryArray) -> None:
        data, off = utf8(units)
        words, sizes = units.to_pylist(), np.diff(off)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        plain = SPACE[data[off[:-1]]] & (data[off[1:] - 1] > 0x20) & ~_after_wide_space(data, off[1:])
        at, n, flat, filled = np.zeros(len(units), np.int64), np.zeros(len(units), np.int32), [], len(self.flat)
        part = np.flatnonzero(plain)
        groups = [part[i:i + JOINED] for i in range(0, len(part), JOINED)]
        other = [np.flatnonzero(~plain)]
        for group, ids in zip(groups, self._encode([b"".join([words[i] for i in g.tolist()]).decode() for g in groups])):
            ends, want = np.cumsum(self.sizes[ids]), np.cumsum(sizes[group])
            cut = np.searchsorted(ends, want)
            if len(ids) and ends[-1] == want[-1] and np.array_equal(ends[cut], want):
                n[group] = np.diff(cut, prepend=-1)
                at[group] = filled + cut + 1 - n[group]
                flat.append(ids)
                filled += len(ids)
            else:
                other.append(group)
        rest = np.concatenate(other).tolist()
        for i, ids in zip(rest, self._encode([words[i].decode() for i in rest])):
            at[i], n[i] = filled, len(ids)
            flat.append(ids)
            filled += len(ids)
        self.held += len(data) + len(words) * ENTRY_BYTES + 4 * (filled - len(self.flat))
        self.at, self.n, self.flat = np.concatenate([self.at, at]), np.concatenate([self.n, n]), np.concatenate([self.flat, *flat])

    def _units(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Places at which a unit starts, and the end of the last one."""
        mark = np.zeros(len(raw) + 1, bool)
        if len(raw):
            space = SPACE[raw]
            fresh = space[1:] & ~space[:-1]
            at = np.flatnonzero(fresh & (raw[:-1] >= 0x80)) + 1
            mark[1:-1] = fresh | (_LETTER[raw[:-1]] & _SIGN[raw[1:]])
            mark[at[_after_wide_space(raw, at)]] = False
        mark[off] = True
        return np.flatnonzero(mark)

    def encode(self, col: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows and the offsets of the rows; ``end_id`` closes every row. Null counts as empty."""
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        n = len(col)
        raw, off = utf8(col)
        whole = set()
        for s in self.special if n else []:
            whole |= set(np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring(col, s), False))).tolist())
        pos = self._units(raw, off)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pos) - 1, [None, pa.py_buffer(pos.astype(np.int64)), pa.py_buffer(raw)])
        coded = units.dictionary_encode()
        words = coded.dictionary
        known = np.fromiter(map(self.known.get, words.to_pylist(), repeat(-1)), np.int64, len(words))
        if len(words) and known.min() < 0:
            if self.held > CACHE_BYTES:
                self._forget()
                known[:] = -1
            missing = np.flatnonzero(known < 0)
            known[missing] = len(self.known) + np.arange(len(missing))
            self._learn(words.take(pa.array(missing)))
        index = known[np.asarray(coded.indices)] if len(units) else np.zeros(0, np.int64)
        count = self.n[index]
        before = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        ids = self.flat[np.repeat(self.at[index] - before[:-1], count) + np.arange(before[-1])] if before[-1] else np.zeros(0, np.int32)
        bounds = before[np.searchsorted(pos, off)]
        if whole:
            parts = [self._encode([col[i].as_py()])[0] if i in whole else ids[bounds[i]:bounds[i + 1]] for i in range(n)]
            bounds = np.zeros(n + 1, np.int64)
            np.cumsum([len(p) for p in parts], out=bounds[1:])
            ids = np.concatenate(parts)
        if end_id is not None:
            out = np.full(len(ids) + n, end_id, np.int32)
            keep = np.ones(len(out), bool)
            keep[bounds[1:] + np.arange(n)] = False
            out[keep] = ids
            ids, bounds = out, bounds + np.arange(n + 1)
        return ids, bounds


_ENCODERS: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """The worker process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def byte_tokenizer() -> str:
    """Path of the public byte-level tokenizer on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
