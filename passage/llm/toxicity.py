"""Toxicity of texts that may be disguised: a noisy channel is decoded first.

A word as written (digits and signs for letters, letters repeated, letters
set apart by spaces or marks) is a noisy form of an intended word. Its lattice
holds, for each character, the letters it may stand for, dropping it (marks,
repetitions) and their costs; Viterbi finds the cheapest path under a
character trigram model counted over the whole corpus. Costs keep plain words: letters
that only stand twice, spaces between words and signs that may be numbers are
read as disguise if that is cheaper by more than a fixed cost. Spaces, and
lone marks between them, are dropped where a short unit adjoins; runs of
single characters are put together. All-digit words mostly stay numbers. The
restored words are scored by the n-gram classifier (``textlr``) fitted on
labelled rows.

Edge cases: null and empty texts get the score of a text without evidence;
repeated rows get equal scores; an empty table gives no rows; a null
``doc_id`` is never held out nor learnt from; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passage.llm._common import LOWER, slices, text_or_empty, utf8
from passage.llm.textlr import Model, fit, raw_scores

TOXIC_AT = 0.7

# classes of the character model: 0 boundary, 1..26 a..z, 27 any other letter
CLASSES = 28
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[0xC0:0x100] = 27        # first byte of a character beyond ASCII
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x80:0xC0] = True     # further bytes of such a character

# fixed values: what a sign may stand for
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
# costs (negative natural logarithms) of the channel's arcs
KEEP, SUBSTITUTE, DROP_SIGN, DROP_MARK, DROP_REPEAT = 0.0, 1.0, 12.0, 0.5, 0.7
# costs of a word that is disguised at all: by letters that stand twice, by spaces (and of each space dropped)
DOUBLED, JOINED, DROP_SPACE = 12.0, 6.0, 4.0
# costs of a digit or sign of a number, and of another sign, that stands for itself
NUMBER, LONE_SIGN = 2.3, 12.0
#: Runs of this many equal letters, or of one-letter words, count as disguise whatever the costs.
RUN = 3
#: A space may be dropped beside a unit of at most this many characters.
SHORT = 3
#: A longer written word is decoded in consecutive pieces.
PIECE = 48

_EDGE = ".,;:?\"')(]}[{*%&#_~`-/\\<>="
_REPEAT = re.compile(r"(.)\1{%d,}" % (RUN - 1))
_PAIR = re.compile(r"(.)\1")


def char_counts(docs: DataFrame) -> DataFrame:
    """Counts of class trigrams over all texts: (code, n). At most CLASSES**3 rows a task."""
    def run(batches):
        total = np.zeros(CLASSES ** 3, np.int64)
        for b in slices(batches):
            raw, off = utf8(b.column("text"))
            low = LOWER[np.insert(raw, off[:-1], 32)] if len(off) > 1 else raw  # a boundary before each text
            c = _CLASS[low[~_FOLLOWS[low]]]
            c = np.concatenate([[0, 0], c, [0, 0]])
            total += np.bincount(c[:-2] * CLASSES * CLASSES + c[1:-1] * CLASSES + c[2:], minlength=CLASSES ** 3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["code", "n"])

    parts = docs.select(text_or_empty().alias("text")).mapInArrow(run, "code long, n long")
    return parts.groupBy("code").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame) -> np.ndarray:
    """Costs of a class after two others, interpolated with shorter contexts (CLASSES**3 numbers)."""
    counts = np.zeros(CLASSES ** 3)
    for r in char_counts(docs).collect():  # bounded by the alphabet
        counts[r.code] = r.n
    three = counts.reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = (two + 10 * p1) / (two.sum(1, keepdims=True) + 10)
    p3 = (three + 10 * p2[None]) / (three.sum(2, keepdims=True) + 10)
    return -np.log(p3)


def _arcs(piece: str):
    """For each character the arcs (letter or "" for none, cost)."""
    out, last = [], ""
    for ch in piece:
        if ch.isalpha():
            arcs = [(ch, KEEP)]
        else:
            arcs = [(x, SUBSTITUTE) for x in LEET.get(ch, "")] + [("", DROP_SIGN if ch in LEET else DROP_MARK)]
        if ch == last:
            arcs.append(("", DROP_REPEAT))
        out.append(arcs)
        last = ch
    return out


def _class(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27


def _joined_arcs(text: str):
    """Arcs of a word put together from restored units: letters that stand twice are kept."""
    return [[x for x in arcs if x != ("", DROP_REPEAT)] if ch.isalpha() else arcs for ch, arcs in zip(text, _arcs(text))]


def _step(best: dict, arcs, costs: np.ndarray) -> dict:
    """The last two classes -> cost, reading; one character further."""
    new: dict = {}
    for (a, b), (cost, text) in best.items():
        for letter, price in arcs:
            if letter:
                c = _class(letter)
                key, total = (b, c), cost + price + costs[a, b, c]
            else:
                key, total = (a, b), cost + price
            if key not in new or total < new[key][0]:
                new[key] = (total, text + letter)
    return new


def _end(best: dict, costs: np.ndarray) -> tuple[float, str]:
    return min((cost + costs[a, b, 0], text) for (a, b), (cost, text) in best.items())


def _cheapest(piece: str, costs: np.ndarray) -> tuple[float, str]:
    best = {(0, 0): (0.0, "")}
    for arcs in _arcs(piece):
        best = _step(best, arcs, costs)
    return _end(best, costs)


def viterbi(piece: str, costs: np.ndarray) -> str:
    """The cheapest reading of a written word under the channel and the character model."""
    return _cheapest(piece, costs)[1]


def kept(piece: str, costs: np.ndarray) -> float:
    """The cost of a piece of letters only, read as written."""
    a = b = 0
    total = 0.0
    for ch in piece:
        a, b, total = b, _class(ch), total + costs[a, b, _class(ch)]
    return float(total + costs[a, b, 0])


def literal(word: str) -> float:
    """The cost of a word without letters, read as written."""
    number, total, last = any(ch.isdigit() for ch in word), 0.0, ""
    for ch in word:
        if ch in LEET:
            total += NUMBER if number else DROP_REPEAT if ch == last else LONE_SIGN
        else:
            total += DROP_MARK
        last = ch
    return total


def stripped(word: str) -> str:
    w = word.strip(_EDGE)
    body = w.rstrip("!$")
    if not any(ch.isalnum() for ch in body):
        return w.rstrip("!")
    return body if len(w) - len(body) != 1 or w.endswith("!") else w


# kinds of units: letters only, letters and others, marks, others that may be letters, others
LETTERS, MIXED, MARK, SIGNS, OTHER = range(5)


def _kind(w: str) -> int:
    if w.isalpha():
        return LETTERS
    if any(ch.isalpha() for ch in w) or w in ("@", "$"):
        return MIXED
    if not w or (len(w) == 1 and not w.isdigit()):
        return MARK
    return SIGNS if len(w) < SHORT and all(ch in LEET for ch in w) else OTHER


class Restorer:
    """Restores the written words of a batch; remembers words it has decoded."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.decoded = lru_cache(200_000)(self._decode)
        self.segments = lru_cache(50_000)(self._segments)

    def _decode(self, word: str) -> tuple[float, str]:
        """Cost and reading of a word without its outer marks."""
        pieces = [word[at:at + PIECE] for at in range(0, len(word), PIECE)]
        if word.isalpha():
            plain = sum(kept(p, self.costs) for p in pieces)
            if not _PAIR.search(word):
                return plain, word
        elif any(ch.isalpha() for ch in word):
            plain = np.inf
        else:  # a lone sign is a mark
            plain = literal(word)
            if len(word) < 2 or not any(ch in LEET for ch in word):
                return plain, word
        got = [_cheapest(p, self.costs) for p in pieces]
        cost, text = sum(c for c, _ in got), "".join(t for _, t in got)
        if word.isalpha() and not _REPEAT.search(word):
            cost += DOUBLED
        return (cost, text) if text and cost < plain or plain == np.inf or _REPEAT.search(word) and word.isalpha() else (plain, word)

    def word(self, word: str) -> str:
        w = stripped(word)
        reading = self.decoded(w)[1]
        signs = word.strip(_EDGE).rstrip("!")
        if len(signs) > len(w) and "$" in signs[len(w):]:  # signs cut off at the end may be letters as well
            cost, other = self.decoded(signs)
            if cost < self.decoded(w)[0]:
                return other
        return reading

    def together(self, text: str) -> str:
        """The reading of a word put together (of at most PIECE characters)."""
        state = {(0, 0): (0.0, "")}
        for arcs in _joined_arcs(text):
            state = _step(state, arcs, self.costs)
        return _end(state, self.costs)[1]

    def _segments(self, units: tuple[str, ...], marks: tuple[int, ...]) -> tuple[int, ...]:
        """How many units form each word of a run of adjoining units; ``marks``: lone marks before each."""
        n = len(units)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(np.inf, 0)] * n  # cost of the first units, where their last word starts
        for i in range(n):
            alone = best[i][0] + self.decoded(units[i])[0]
            if alone < best[i + 1][0]:
                best[i + 1] = (alone, i)
            j, size = i, 0
            while j < n and size + len(units[j]) <= PIECE:
                size += len(units[j])
                j += 1
            state, at, arcs, extra = {(0, 0): (0.0, "")}, 0, _joined_arcs("".join(units[i:j])), JOINED
            for k in range(i, j):
                for _ in units[k]:
                    state = _step(state, arcs[at], self.costs)
                    at += 1
                if k > i:
                    extra += DROP_SPACE + DROP_MARK * marks[k]
                    cost = best[i][0] + extra + _end(state, self.costs)[0]
                    if cost < best[k + 1][0]:
                        best[k + 1] = (cost, i)
        out = []
        while n:
            out.append(n - best[n][1])
            n = best[n][1]
        return tuple(reversed(out))

    def _classes(self, words: list[bytes]):
        """Classes of all bytes, one more than there are; where the words begin and their lengths; which are of a..z only."""
        size = np.fromiter((len(w) for w in words), np.int64, len(words))
        begin = np.cumsum(size) - size
        c = np.append(_CLASS[np.frombuffer(b"".join(words), np.uint8)], 0)
        odd = np.concatenate([[0], np.cumsum((c[:-1] == 0) | (c[:-1] == 27))])
        return c, begin, size, (size > 0) & (odd[begin + size] == odd[begin])

    def _plain(self, words: list[bytes]) -> np.ndarray:
        """Words of a..z that the costs keep: dropping a letter that stands twice changes two terms of a word's cost, so
        the cheapest reading is known without a lattice. Words with a longer run go through it."""
        c, begin, size, plain = self._classes(words)
        if len(c) < 3:
            return plain
        of = np.repeat(np.arange(len(words)), size)
        at = np.flatnonzero((c[1:-1] == c[:-2]) & (of[1:] == of[:-1]) & plain[of[1:]]) + 1  # the second of the two
        w = of[at]
        a = np.where(at - 2 >= begin[w], c[at - 2], 0)
        b = np.where(at + 1 < begin[w] + size[w], c[at + 1], 0)
        C, x = self.costs, c[at]
        gain = np.maximum(C[a, x, x] + C[x, x, b] - C[a, x, b] - DROP_REPEAT, 0)
        gain[(a == x) | (b == x)] = np.inf
        return plain & (np.bincount(w, gain, len(words)) <= DOUBLED)

    def _ends(self, texts: list[str], new: list[bytes], words: list[bytes]):
        """Of each unit: kind, length, classes of the first two and (reversed) of the last two characters."""
        plain = self._classes(words)[3]
        c, begin, size, _ = self._classes(new)
        kind = np.where(plain, LETTERS, OTHER)
        edge = np.zeros((4, len(new)), np.int64)
        for k, at, least in ((0, begin, 1), (1, begin + 1, 2), (2, begin + size - 1, 1), (3, begin + size - 2, 2)):
            ok = plain & (size >= least)
            edge[k, ok] = c[at[ok]]
        for i in np.flatnonzero(~plain).tolist():
            w = stripped(texts[i])
            kind[i] = _kind(w)
            if kind[i] == LETTERS:
                w = new[i].decode()
                edge[:, i] = _class(w[0]), _class(w[1]) if len(w) > 1 else 0, _class(w[-1]), _class(w[-2]) if len(w) > 1 else 0
            size[i] = len(w)
        return kind, size, edge

    def _spaced(self, words: list[bytes], texts: list[str], new: list[bytes], index: np.ndarray, bounds: np.ndarray):
        """Runs of units that may be one word apart by spaces and lone marks: (positions, units, lone marks before each)."""
        kind, size, (first, second, last, before) = self._ends(texts, new, words)
        at = np.flatnonzero(kind[index] != MARK)
        if len(at) < 2:
            return
        row = np.searchsorted(bounds, at, side="right")
        u, v = index[at[:-1]], index[at[1:]]
        marks = np.diff(at) - 1
        ku, kv = kind[u], kind[v]
        near = (row[1:] == row[:-1]) & (np.minimum(size[u], size[v]) <= SHORT) & (marks <= 1) & (ku != OTHER) & (kv != OTHER)
        # numbers beside single characters only
        near &= ((ku != SIGNS) | ((kv != SIGNS) & (size[v] == 1))) & ((kv != SIGNS) | ((ku != SIGNS) & (size[u] == 1)))
        g = np.flatnonzero(near)
        if not len(g):
            return
        u, v = u[g], v[g]
        # what dropping a space between letters saves at most; other units are always tried
        C, x, y, c, d = self.costs, before[u], last[u], first[v], second[v]
        ahead = np.where((g > 0) & (size[u] == 1), last[index[at[np.maximum(g - 1, 0)]]], x)
        gain = C[x, y, 0] + C[0, 0, c] - np.minimum(C[x, y, c], C[ahead, y, c]) - DROP_SPACE - DROP_MARK * marks[g]
        gain += np.where(size[v] > 1, C[0, c, d] - C[y, c, d], np.maximum(C[0, c, 0] - C[y, c, 0], 0))
        gain = np.where((kind[u] == LETTERS) & (kind[v] == LETTERS), gain, 2 * JOINED)
        begins = np.flatnonzero(np.diff(g, prepend=-2) != 1)
        # the most that any adjoining gaps of a run save together; runs are set apart by a large step
        apart = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(g))) * (np.abs(gain).sum() + 1)
        upto = np.cumsum(gain) - apart
        most = np.maximum.reduceat(upto - np.minimum.accumulate(upto - gain), begins)
        stops = np.append(begins[1:], len(g))
        for a, e in zip(begins[most > JOINED].tolist(), stops[most > JOINED].tolist()):
            p = at[g[a]:g[e - 1] + 2]
            units = tuple(new[k].decode() if kind[k] == LETTERS else stripped(texts[k]) for k in index[p].tolist())
            yield p, units, tuple((np.diff(p, prepend=p[0] - 1) - 1).tolist())

    def __call__(self, words: list[bytes], index: np.ndarray, bounds: np.ndarray):
        """Rewrite of a batch's units: words restored, units that form one word put together."""
        words, texts = list(words), [w.decode("utf-8") for w in words]
        new = [w if same else self.word(t).encode() for w, t, same in zip(words, texts, self._plain(words).tolist())]
        index, bounds = self._singles(words, texts, new, index, bounds)
        keep, put = np.ones(len(index), bool), {}
        for p, units, marks in self._spaced(words, texts, new, index, bounds):
            i = 0
            for n in self.segments(units, marks):
                if n > 1:
                    put[int(p[i])] = len(new)
                    new.append(self.together("".join(units[i:i + n])).encode())
                    keep[p[i] + 1:p[i + n - 1] + 1] = False
                i += n
        if not put:
            return new, index, bounds
        index = index.copy()
        index[list(put)] = list(put.values())
        before = np.zeros(len(index) + 1, np.int64)
        np.cumsum(keep, out=before[1:])
        return new, index[keep], before[bounds]

    def _singles(self, words: list[bytes], texts: list[str], new: list[bytes], index: np.ndarray, bounds: np.ndarray):
        """Runs of single characters put together."""
        single = np.array([len(stripped(t)) == 1 for t in texts], bool)
        if not single.any():
            return index, bounds
        one = single[index]
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        begins = one.copy()
        begins[1:] &= ~one[:-1] | (row[1:] != row[:-1])
        start = np.flatnonzero(begins)
        if not len(start):
            return index, bounds
        ends = one.copy()
        ends[:-1] &= ~one[1:] | (row[1:] != row[:-1])
        stop = np.flatnonzero(ends) + 1
        long = stop - start >= RUN
        extra = np.empty(int(long.sum()), np.int64)
        keep = np.ones(len(index), bool)
        index = index.copy()
        for k, (a, e) in enumerate(zip(start[long].tolist(), stop[long].tolist())):
            texts.append("".join(stripped(texts[i]) for i in index[a:e]))
            words.append(texts[-1].encode())
            new.append(self.word(texts[-1]).encode())
            extra[k] = len(new) - 1
            keep[a + 1:e] = False
        index[start[long]] = extra
        before = np.zeros(len(index) + 1, np.int64)
        np.cumsum(keep, out=before[1:])
        return index[keep], before[bounds]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, costs: np.ndarray) -> Model:
    """Learns from labels of documents that are not held out."""
    rows = labels.where(~held_out()).select("doc_id", F.col("toxic").alias("y"))
    return fit(docs, rows, lower=True, rewrite=lambda: Restorer(costs))


def score_documents(docs: DataFrame, model: Model, costs: np.ndarray) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    def run(batches):
        restore = Restorer(costs)
        for b in slices(batches):
            p = model.probability(raw_scores(b.column("text"), model, True, restore))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= TOXIC_AT).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def restore_text(text: str, costs: np.ndarray) -> str:
    """One text with its disguised words restored (words joined by single spaces)."""
    words, bounds = [w.encode() for w in text.lower().split()], None
    new, index, _ = Restorer(costs)(words, np.arange(len(words)), np.array([0, len(words)]) if bounds is None else bounds)
    return " ".join(new[i].decode() for i in index)
