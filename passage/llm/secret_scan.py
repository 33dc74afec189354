"""Secret scan: fixed patterns and a token-efficiency test.

Natural strings of a language take few tokens for their length, random ones
many. A run of 20 or more key characters is reported as ``random`` if its
lowest ratio of characters to tokens under a public byte-level vocabulary is
at most ``RANDOM_AT``. The ratio is taken of the run, of its parts between
separators and of every window of 20 characters of a longer part (a token cut
by a window's edge counts by its share), so a key behind a path or a name
isn't averaged away; windows across separators count if they are mixed
(lower case, upper case and digits) and hold no word. Known digests
(hexadecimal of a digest's length) and UUIDs are cut out of a run first; the
ratio of the run as a whole doesn't count if it is an identifier, i.e. if
words the vocabulary knows make up most of it.

Edge cases: null and empty texts have no spans; overlapping spans of
different kinds are all kept; repeated rows get equal results; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passage.llm._common import slices, text_or_empty
from passage.llm.spans import Span, flagged, joined, sha256

# fixed values: the patterns of the base kinds
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
VALUE_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")
# what a text must hold for a pattern to match at all, for a linear-time search
_NEEDS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "random": r"[A-Za-z0-9+/_=-]{20}",
}

RANDOM_CHARS = 20
RANDOM_AT = 2.1
#: A longer run is tested by consecutive pieces of this many characters.
PIECE = 4096
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 (fixed values)
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
_UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
# known strings, standing by themselves between separators
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:%s|%s)(?![A-Za-z0-9])" % (_UUID, "|".join("[0-9a-fA-F]{%d}" % n for n in DIGEST_CHARS)))
_SOLID = re.compile(r"[A-Za-z0-9]+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: An identifier's letters and digits are words to this share.
WORDS_SHARE = 0.75


class TokenTest:
    """Characters per token under a vocabulary of ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, run: str) -> float:
        n = sum(len(self.encoding.encode_ordinary(run[a:a + PIECE])) for a in range(0, len(run), PIECE))
        return len(run) / max(n, 1)

    def upto(self, run: str) -> np.ndarray:
        """Tokens before each character of an ASCII run and at its end, each token spread evenly over its characters."""
        size = np.array([len(self.encoding.decode_single_token_bytes(t)) for a in range(0, len(run), PIECE)
                         for t in self.encoding.encode_ordinary(run[a:a + PIECE])], np.int64)
        return np.concatenate([[0.0], np.cumsum(np.repeat(1 / size, size))])

    def random(self, run: str) -> bool:
        return any(self._random(rest) for rest in _KNOWN.split(run) if len(rest) >= RANDOM_CHARS)

    def _random(self, run: str) -> bool:
        if self.ratio(run) <= RANDOM_AT and not self.identifier(run):
            return True
        if len(run) <= RANDOM_CHARS:
            return False
        upto = self.upto(run)
        dense = upto[RANDOM_CHARS:] - upto[:-RANDOM_CHARS] >= RANDOM_CHARS / RANDOM_AT - 1e-9
        if not dense.any():  # a longer part is no denser than its densest window
            return False
        words = np.zeros(len(run) + 1, np.int64)  # letters of words before each character
        solid = np.zeros(len(run) + 1, np.int64)
        lower, upper, digit = (np.concatenate([[0], np.cumsum([f(c) for c in run])]) for f in (str.islower, str.isupper, str.isdigit))
        for m in _SOLID.finditer(run):
            solid[m.start() + 1:m.end() + 1] = 1
            for w in _WORD.finditer(m[0]):
                if self.word(w[0], 4):
                    words[m.start() + w.start() + 1:m.start() + w.end() + 1] = 1
        words, solid = np.cumsum(words), np.cumsum(solid)

        def inside(count):
            return count[RANDOM_CHARS:] - count[:-RANDOM_CHARS]
        mixed = (inside(lower) > 0) & (inside(upper) > 0) & (inside(digit) > 0)
        return bool((dense & ((inside(solid) == RANDOM_CHARS) | (mixed & (inside(words) == 0)))).any())

    def word(self, part: str, least: int = 1) -> bool:
        """Letters the vocabulary knows as a word of a text: one token, or few for their number in every window."""
        if len(part) < least:
            return False
        plain = " " + part.lower()
        if len(part) <= 3:
            return len(self.encoding.encode_ordinary(plain)) == 1
        upto = self.upto(plain)
        if len(part) / round(float(upto[-1])) <= RANDOM_AT:
            return False
        return len(part) <= RANDOM_CHARS or float((upto[RANDOM_CHARS:] - upto[:-RANDOM_CHARS]).max()) < RANDOM_CHARS / RANDOM_AT

    def identifier(self, run: str) -> bool:
        """Words, joined by separators or in camel case, with little else. Short words count between separators only."""
        known = total = 0
        for part in _SOLID.findall(run):
            total += len(part)
            pieces = _WORD.findall(part)
            known += sum(len(w) for w in pieces if self.word(w, 1 if w == part else 4))
        return total > 0 and known >= WORDS_SHARE * total


def base_spans(text: str, needs: dict[str, bool]) -> list[Span]:
    out: list[Span] = []
    if needs["assign"]:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= VALUE_CHARS]
    if needs["access"]:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    if needs["hex"]:
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= HEX_CHARS]
    return out


def random_spans(text: str, test: TokenTest) -> list[Span]:
    return [("random", m.start(), m.end()) for m in _RUN.finditer(text) if test.random(m[0])]


_TESTS: dict[str, TokenTest] = {}


def scan(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of every document."""
    def run(batches):
        if vocabulary not in _TESTS:
            _TESTS[vocabulary] = TokenTest(vocabulary, pattern)
        test, nothing = _TESTS[vocabulary], sha256("")
        for b in slices(batches):
            col = b.column("text")
            need = {k: flagged(col, p) for k, p in _NEEDS.items()}
            n = b.num_rows
            counts = {k: np.zeros(n, np.int64) for k in KINDS}
            digest, listed = [nothing] * n, [""] * n
            for i in np.flatnonzero(np.any(list(need.values()), axis=0)).tolist():
                text = col[i].as_py()
                base = base_spans(text, {k: bool(v[i]) for k, v in need.items()})
                more = random_spans(text, test) if need["random"][i] else []
                for k, _, _ in base + more:
                    counts[k][i] += 1
                digest[i], listed[i] = sha256(joined(base, KINDS)), joined(base + more, KINDS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(counts[k]) for k in KINDS), pa.array(digest), pa.array(listed)],
                                             names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)
