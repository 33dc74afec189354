"""Logistic regression over hashed word and character n-grams.

A text is a bag of units (runs between white space). Every unit gives its
whole-word feature and the character n-grams of the word between two boundary
marks, hashed into ``2**BITS`` weights; a text's value is the sum over its
units divided by the square root of their number, so long texts gain evidence
without gaining noise. Weights are fitted on a bounded sample of labelled
rows in one task; scoring is one pass over Arrow batches in which every
distinct unit is scored once a batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passage.llm._common import BASES, LOWER, byte_codes, give_back, mix64, powers, row_sums, slices, text_or_empty, utf8, word_bounds

BITS = 18
GRAMS = (4, 5, 6)
#: Labelled rows used for fitting, the rest are not needed; one in FOLD of them calibrates.
SAMPLE_ROWS = 6000
FOLD = 5
EPOCHS = 16
BATCH = 64
RATE = 0.3
L2 = 1e-5
#: Longer words give n-grams of consecutive pieces of this many bytes.
PIECE = 64
#: Words whose features are made at once: these take some 200 bytes of memory for each byte of a word.
WORDS = 4096
#: Text that the fit turns into sparse rows at once.
SLICE = 1 << 18


@dataclass
class Model:
    weights: np.ndarray   # float32, 2**BITS
    bias: float
    slope: float          # Platt's calibration of the raw value
    shift: float

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (raw + self.bias) + self.shift, -30, 30)))


def units(col: pa.Array, lower: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct units, each occurrence's place among them, and the bounds of the rows."""
    raw, off = utf8(col)
    if lower:
        raw = LOWER[raw]
    starts, ends, bounds = word_bounds(raw, off)
    if not len(starts):
        return [], np.zeros(0, np.int64), bounds
    # words lie apart by white space: copy them together for Arrow's dictionary encoding
    size = ends - starts
    place = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=place[1:])
    flat = raw[np.repeat(starts - place[:-1], size) + np.arange(place[-1])]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(flat)])
    coded = words.dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices), bounds


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of the words and the bounds of each word's features."""
    places, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for at in range(0, len(words), WORDS):
        place, bounds = _features(words[at:at + WORDS])
        places.append(place)
        sizes.append(np.diff(bounds))
    return np.concatenate(places), np.cumsum(np.concatenate(sizes))


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    framed, owner = [], []
    for i, w in enumerate(words):
        for at in range(0, max(len(w), 1), PIECE):
            framed.append(b"\x02" + w[at:at + PIECE] + b"\x03")
            owner.append(i)
    size = np.array([len(f) for f in framed])
    who = np.array(owner)
    raw = np.frombuffer(b"".join(framed), np.uint8)
    first = np.cumsum(size) - size
    codes = byte_codes(7)[raw]
    places, owners = [], []
    with np.errstate(over="ignore"):
        at = np.arange(len(raw)) - np.repeat(first, size)
        whole = np.add.reduceat(codes * powers(BASES[1], int(size.max()))[at], first)
        places.append(mix64(whole))
        owners.append(who)
        left = np.repeat(size, size) - at
        for n in GRAMS:
            ok = np.flatnonzero(left >= n)
            h = np.zeros(len(ok), np.uint64)
            for j in range(n):
                h = h * np.uint64(BASES[0]) + codes[ok + j]
            places.append(mix64(h + np.uint64(n)))
            owners.append(np.repeat(who, size)[ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    place = (np.concatenate(places)[order] >> np.uint64(64 - BITS)).astype(np.int32)
    return place, np.searchsorted(owner[order], np.arange(len(words) + 1))


def unit_scores(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    out = [np.zeros(0)]
    for at in range(0, len(words), WORDS):
        place, bounds = _features(words[at:at + WORDS])
        out.append(row_sums(weights[place].astype(np.float64), bounds))
    return np.concatenate(out)


#: Turns the units of a batch into other units: (words, index, bounds) to the same.
Rewrite = Callable[[list[bytes], np.ndarray, np.ndarray], tuple[list[bytes], np.ndarray, np.ndarray]]


def raw_scores(col: pa.Array, model: Model, lower: bool, rewrite: Rewrite | None = None, coded: tuple | None = None) -> np.ndarray:
    """The raw value of each text; ``coded`` is ``units(col, lower)`` if already at hand."""
    words, index, bounds = coded or units(col, lower)
    if rewrite:
        words, index, bounds = rewrite(words, index, bounds)
    by_word = unit_scores(words, model.weights)
    total = row_sums(by_word[index], bounds) if len(index) else np.zeros(len(bounds) - 1)
    return total / np.sqrt(np.maximum(np.diff(bounds), 1))


#: A sparse row: places, how often each feature occurs (as bytes where they suffice), and the root of the number of units.
Row = tuple[np.ndarray, np.ndarray, float]


def _values(row: Row) -> np.ndarray:
    return (row[1].astype(np.float64) / row[2]).astype(np.float32)


def _rows(col: pa.Array, lower: bool, rewrite: Rewrite | None):
    """Sparse rows of each text."""
    words, index, bounds = units(col, lower)
    if rewrite:
        words, index, bounds = rewrite(words, index, bounds)
    place, fb = features(words)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if a == b:
            yield np.zeros(0, np.int32), np.zeros(0, np.uint8), 1.0
            continue
        w, n = np.unique(index[a:b], return_counts=True)
        cnt = fb[w + 1] - fb[w]
        src = np.repeat(fb[w] - (np.cumsum(cnt) - cnt), cnt) + np.arange(cnt.sum())
        p, back = np.unique(place[src], return_inverse=True)
        times = np.bincount(back, np.repeat(n, cnt))
        yield p, times.astype(np.min_scalar_type(int(times.max(initial=0)))), float(np.sqrt(b - a))


def fit_rows(rows: list[Row], y: np.ndarray) -> Model:
    """AdaGrad on the logistic loss; a fold left out fits the calibration."""
    n = len(rows)
    w, g2 = np.zeros(1 << BITS, np.float32), np.full(1 << BITS, 1e-2, np.float32)
    if n == 0:
        return Model(w, 0.0, 1.0, 0.0)
    prior = (y.sum() + 1.0) / (n + 2.0)
    bias = float(np.log(prior / (1 - prior)))
    left_out = np.arange(n) % FOLD == FOLD - 1 if n >= 20 * FOLD else np.zeros(n, bool)
    train = np.flatnonzero(~left_out)
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for at in range(0, len(train), BATCH) if len(train) else ():
            pick = rng.choice(train, BATCH) if len(train) > BATCH else train
            size = np.array([len(rows[i][0]) for i in pick])
            p = np.concatenate([rows[i][0] for i in pick])
            v = np.concatenate([_values(rows[i]) for i in pick])
            who = np.repeat(np.arange(len(pick)), size)
            z = np.bincount(who, w[p] * v, len(pick)) + bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            at_p, back = np.unique(p, return_inverse=True)
            grad = (np.bincount(back, err[who] * v) + L2 * w[at_p]).astype(np.float32)
            g2[at_p] += grad * grad
            w[at_p] -= RATE * grad / np.sqrt(g2[at_p])
    fold = np.flatnonzero(left_out)
    if len(fold) < 20 or len(np.unique(y[fold])) < 2:
        return Model(w, bias, 1.0, 0.0)
    z = np.array([float((w[rows[i][0]] * _values(rows[i])).sum()) + bias for i in fold])
    pos, neg = y[fold].sum(), len(fold) - y[fold].sum()
    goal = np.where(y[fold] == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))  # Platt's targets
    a, b = 1.0, 0.0

    def loss(a, b):
        u = a * z + b
        return (np.logaddexp(0, u) - goal * u).sum() + 0.5 * (a - 1) ** 2

    for _ in range(50):  # Newton's steps, halved until the loss falls; the slope is held near 1
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, h = q - goal, q * (1 - q) + 1e-9
        g = np.array([(d * z).sum() + (a - 1), d.sum()])
        hess = np.array([[(h * z * z).sum() + 1, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        while loss(a - step[0], b - step[1]) > loss(a, b) and np.abs(step).max() > 1e-7:
            step = step / 2
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(w, bias, max(float(a), 1e-3), float(b))


def fit(docs: DataFrame, labels: DataFrame, lower: bool, rewrite: Callable[[], Rewrite] | None = None,
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` rows of ``labels`` (doc_id, y in 0/1),
    chosen by a hash of the id, one text each. One task fits; its input is that bounded sample."""
    chosen = (labels.where("doc_id is not null and y is not null").select(F.col("doc_id").alias("_id"), F.col("y").cast("int").alias("y"))
              .distinct().orderBy(F.xxhash64("_id"), "_id", "y").limit(sample_rows))
    texts = docs.select(F.col("doc_id").alias("_id"), text_or_empty().alias("text"))
    # one text of an id and label, that of the smallest hash, however often the id is repeated
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    sample = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "y").agg(one.alias("one")).select("_id", "one.text", "y")

    def run(batches):
        change = rewrite() if rewrite else None
        got = []
        for b in slices(batches, limit=SLICE):
            ids = b.column("_id").to_pylist()
            got += [(i, y, r) for i, y, r in zip(ids, b.column("y").to_pylist(), _rows(b.column("text"), lower, change))]
            give_back()  # else what a slice took stays between the rows kept of it
        got.sort(key=lambda g: (mix64(np.array([g[0]], np.int64).view(np.uint64))[0], g[0], g[1]))  # whatever order rows arrive in
        m = fit_rows([g[2] for g in got], np.array([g[1] for g in got], float))
        del got
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), pa.array([m.bias]), pa.array([m.slope]), pa.array([m.shift])],
                                         names=["weights", "bias", "slope", "shift"])

    row = sample.repartition(1).mapInArrow(run, "weights binary, bias double, slope double, shift double").first()
    if row is None:
        return fit_rows([], np.zeros(0))
    return Model(np.frombuffer(bytes(row.weights), np.float32), row.bias, row.slope, row.shift)
