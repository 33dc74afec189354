"""Spans of a text: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Span = tuple[str, int, int]


def joined(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then by the order of ``kinds``, joined by commas."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{e}" for k, a, e in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def flagged(col: pa.Array, pattern: str) -> np.ndarray:
    """Rows in which a linear-time search finds ``pattern`` (which must be implied by the exact one)."""
    if not len(col):
        return np.zeros(0, bool)
    return np.asarray(pc.fill_null(pc.match_substring_regex(col, pattern), False))


def masked(text: str, spans: Iterable[Span], mark: Callable[[str], str]) -> str:
    """The text with its spans replaced by marks; overlapping spans are replaced as one, named after the first."""
    out, at = [], 0
    for kind, a, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mark(kind)]
        at = max(at, e)
    return "".join(out) + text[at:]
