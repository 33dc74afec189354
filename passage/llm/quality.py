"""Quality rules: fixed text rules and a calibrated n-gram classifier.

Rules reject a text of fewer than 20 words or with more than 30% of its words
in repeated 8-word windows. The others are judged by logistic regression over
hashed word and character n-grams (``textlr``), fitted on labelled rows and
calibrated on a fold left out: a text stays if its probability of good
quality reaches ``KEEP_AT``.

Edge cases: null and empty texts have no words and fail the rules; repeated
rows get equal verdicts; an empty table gives no rows; without labels the
classifier is neutral and only the rules decide; the filter passes every
column through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passage.llm._common import BASES, SPACE, give_back, mix64, row_sums, over_texts, slices, text_or_empty, utf8
from passage.llm.textlr import Model, fit, raw_scores, units

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
KEEP_AT = 0.5
SYMBOLS = "#*$%&|<>"
#: Text judged at once; a longer one is judged alone.
SLICE = 1 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the values that occur more than once."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(s), bool)
    out[order] = same
    return out


def measures(col: pa.Array, coded: tuple | None = None) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each
    text; ``coded`` is ``units(col, False)`` if already at hand."""
    _, index, bounds = coded or units(col, False)
    raw, off = utf8(col)
    rows = len(off) - 1
    n_words = np.diff(bounds)
    chars = row_sums((((raw & 0xC0) != 0x80) & ~SPACE[raw]).astype(np.int64), off)
    symbols = row_sums(_SYMBOL[raw].astype(np.int64), off)
    return {"n_words": n_words.astype(np.int64), "word_chars": chars, "n_symbols": symbols,
            "n_dup_lines": _dup_lines(raw, off), "n_repeat_words": _repeat_words(index, bounds, rows)}


def _dup_lines(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    rows = len(off) - 1
    if not len(raw):
        return np.zeros(rows, np.int64)
    closed = np.insert(raw, off[1:], 10)  # every row ends with a line feed, so lines are whole values
    ends = np.flatnonzero(closed == 10) + 1
    place = np.concatenate([[0], ends]).astype(np.int64)
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(place), pa.py_buffer(closed)])
    code = np.asarray(lines.dictionary_encode().indices).astype(np.int64)
    worded = np.add.reduceat((~SPACE[closed]).astype(np.int64), place[:-1]) > 0
    row = np.searchsorted(off[1:] + np.arange(1, rows + 1), place[:-1], side="right")
    key = np.sort(((row << 32) | code)[worded])
    again = key[1:][key[1:] == key[:-1]]
    return np.bincount(again >> 32, minlength=rows).astype(np.int64)


def _repeat_words(index: np.ndarray, bounds: np.ndarray, rows: int) -> np.ndarray:
    """Words inside 8-word windows that occur more than once in their text."""
    n = len(index)
    if n < WINDOW:
        return np.zeros(rows, np.int64)
    code = mix64(index.astype(np.uint64))
    row = np.repeat(np.arange(rows), np.diff(bounds))
    h = np.zeros(n - WINDOW + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            h = h * np.uint64(BASES[1]) + code[j:j + len(h)]
        first = np.flatnonzero(row[:len(h)] == row[WINDOW - 1:])
        key = mix64(h[first]) + mix64(row[first].astype(np.uint64) + np.uint64(17))
    hit = first[_repeated(key)]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    return row_sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), bounds)


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])


def fit_quality(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels.select("doc_id", F.col("quality").alias("y")), lower=False)


def _judge(col: pa.Array, model: Model) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    coded = units(col, False)
    m = measures(col, coded)
    failed = base_failed(m)
    p = model.probability(raw_scores(col, model, False, coded=coded))
    return m, failed, p, ~failed & (p >= KEEP_AT)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the measures, base_failed, p_quality and kept for every document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in slices(batches, limit=SLICE):
            m, failed, p, kept = _judge(b.column("text"), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(m[k]) for k in names), pa.array(failed), pa.array(kept), pa.array(p)],
                                             names=["doc_id", *names, "base_failed", "kept", "p_quality"])
        give_back()

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean, p_quality double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were."""
    kept = F.arrow_udf(over_texts(lambda col: pa.array(_judge(col, model)[3]), pa.bool_(), SLICE), "boolean")
    return docs.where(kept(text_or_empty()))
