"""Retrieval packing, phrase mining and hard negatives against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passage.llm import hard_negatives, phrases, queries, retrieval_packing
from passage.llm.byte_tokens import ByteEncoder, byte_tokenizer
from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(byte_tokenizer())


# ------------------------------------------------------- retrieval packing

def test_batches_are_encoded_like_single_texts(tokenizer, monkeypatch):
    rng = random.Random(3)
    signs = list("ab'sdlt reZ09.,!\n\t \r\x0b\x0c\x85\xa0 　é日İ\x1ć²½_|<>") + ["<|endoftext|>", "'s", "'ll", "  "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [None, ""]
    monkeypatch.setattr("passage.llm.byte_tokens.CACHE_BYTES", 100_000)  # it forgets and learns anew
    enc = ByteEncoder(byte_tokenizer())
    for part in (texts[:1000], texts[1000:], texts[:500]):
        ids, bounds = enc.encode(pa.array(part), 0)
        for i, t in enumerate(part):
            assert tokenizer.encode(t or "", add_special_tokens=False).ids + [0] == ids[bounds[i]:bounds[i + 1]].tolist(), repr(t)


def _checked_packing(rows, texts, tokenizer, capacity=1024):
    """Pieces cover every document once, sequences have no gap and are full or a power of two."""
    want = collections.Counter()
    for doc_id, text in texts:
        want[(doc_id, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids + [0]))] += 1
    by_seq, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    expected = collections.Counter()
    for (doc_id, ids), n in want.items():
        raw = np.array(ids, "<u4")
        mine = [r for r in by_doc[doc_id] if r.doc_tokens == len(ids)]
        starts = collections.Counter()
        for r in mine:
            if zlib.crc32(raw[r.start:r.start + r.length].tobytes()) == r.ids_crc32:
                starts[r.start] += r.length
                expected[doc_id] += r.length
        assert sum(starts.values()) == n * len(ids)
    assert sum(r.length for r in rows) == sum(n * len(ids) for (_, ids), n in want.items())
    return by_seq


def test_packing_of_the_table_and_odd_rows(spark, docs_of, tokenizer):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = queries.op11_retrieval_packing(spark, SF_SMALL).collect()
    by_seq = _checked_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert sum(sum(r.length for r in p) < 1024 for p in by_seq.values()) <= 10
    odd = retrieval_packing.pack_related(docs_of(ODD), byte_tokenizer(), shard_rows=4).collect()
    _checked_packing(odd, ODD, tokenizer)
    assert retrieval_packing.pack_related(docs_of(ODD).limit(0), byte_tokenizer()).count() == 0


def test_long_text_leaves_as_full_windows(spark, docs_of, tokenizer):
    long = "some words of a long text, " * 40_000     # a megabyte
    rows = retrieval_packing.pack_related(docs_of([(1, long), (2, "short text")]), byte_tokenizer()).collect()
    full = [r for r in rows if r.doc_id == 1 and r.length == 1024 and r.offset == 0]
    n = len(tokenizer.encode(long, add_special_tokens=False).ids) + 1
    assert len(full) >= n // 1024 and sum(r.length for r in rows if r.doc_id == 1) == n


def _random_shard(rng, docs=60, vocab=40):
    lists = [rng.integers(0, vocab, rng.integers(1, 80)) for _ in range(docs)]
    pairs = [np.unique(x, return_counts=True) for x in lists]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t, _ in pairs])])
    return lists, np.concatenate([t for t, _ in pairs]), np.concatenate([c for _, c in pairs]), bounds


def test_scores_are_bm25():
    rng = np.random.default_rng(5)
    lists, terms, counts, bounds = _random_shard(rng)
    df = np.bincount(terms, minlength=40)
    lengths = np.array([len(x) for x in lists])
    weights = retrieval_packing.Weights(len(lists), lengths.mean(), df)
    index = retrieval_packing.Index(terms, weights.of(terms, counts, np.repeat(lengths, np.diff(bounds))), bounds)

    def weight(t, x):
        tf = (x == t).sum()
        idf = max(math.log((len(lists) - df[t] + 0.5) / (df[t] + 0.5)), 0)
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / lengths.mean()))

    for row in (0, 7, 31):
        mine = sorted({int(t) for t in lists[row]}, key=lambda t: (-weight(t, lists[row]), t))[:6]
        want = [sum(weight(t, x) for t in mine if weight(t, lists[row]) > 0) for x in lists]
        assert np.allclose(index.scores(row, 6), want)


def test_windows_take_the_best_unused_neighbours():
    rng = np.random.default_rng(6)
    lists, terms, counts, bounds = _random_shard(rng)
    lengths = np.array([len(x) for x in lists])
    weights = retrieval_packing.Weights(len(lists), lengths.mean(), np.bincount(terms, minlength=40))
    index = retrieval_packing.Index(terms, weights.of(terms, counts, np.repeat(lengths, np.diff(bounds))), bounds)
    windows = retrieval_packing.fill_windows(index, lengths, 128, 6)
    left, start = lengths.copy(), np.zeros(len(lengths), int)
    order, fresh = list(np.argsort(-lengths, kind="stable")), iter(range(len(lengths)))
    for w in windows:    # the plain way: each window again, by sorting all scores
        seed = next(i for i in order if left[i])
        scores = index.scores(seed, 6)
        queue = [seed] + sorted((i for i in range(len(lengths)) if i != seed and left[i] and scores[i] > 0), key=lambda i: (-scores[i], i))
        queue += [i for i in range(len(lengths)) if i not in queue]
        room, want = 128, []
        for i in queue:
            n = min(room, left[i])
            if n:
                want.append((i, start[i], n))
                left[i], start[i], room = left[i] - n, start[i] + n, room - n
        assert [tuple(map(int, p)) for p in w] == [tuple(map(int, p)) for p in want]
    assert not left.any() and all(sum(n for _, _, n in w) == 128 for w in windows[:-1])
    for part in retrieval_packing.in_powers([(0, 0, 70), (1, 5, 30)]):
        n = sum(k for _, _, k in part)
        assert n & (n - 1) == 0


def test_sequences_hold_the_ids(spark, docs_of, tokenizer):
    texts = [(i, f"text number {i} of the test " * 20) for i in range(40)]
    got = retrieval_packing.sequences(docs_of(texts), byte_tokenizer()).collect()
    ids = [i for r in got for i in np.frombuffer(r.ids, "<u4").tolist()]
    want = [i for _, t in texts for i in tokenizer.encode(t).ids + [0]]
    assert sorted(ids) == sorted(want) and all(len(r.ids) <= 4096 for r in got)


# ------------------------------------------------------------ phrase mining

def _brute_phrases(rows, least):
    f, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[(lang, tuple(w[i:i + k]))] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, q), a in cand.items():
        for k in range(2, len(q)):
            for i in range(len(q) - k + 1):
                if a >= f[(lang, q[i:i + k])]:
                    dropped.add((lang, q[i:i + k]))
    out = set()
    for (lang, p), a in cand.items():
        if (lang, p) not in dropped:
            score, k = min((1000 * a * total[lang] // (f[(lang, p[:k])] * f[(lang, p[k:])]), k) for k in range(1, len(p)))
            out.add((lang, " ".join(p), a, f[(lang, p[:k])], f[(lang, p[k:])], total[lang], score))
    ranked = set()
    for lang in total:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked |= {(lang, i + 1, *r[1:]) for i, r in enumerate(mine)}
    return ranked


@pytest.mark.parametrize("shard_words", [1, 200, 1 << 21])
def test_phrases_equal_brute_force(spark, shard_words):
    rng = random.Random(9)
    words = ["a", "b", "C", "dé", "e\x00", "new", "York"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "de", None])))
    rows += [(None, "en"), ("", None), ("one two three four five six " * 30, "fr"), ("new york new york city. " * 12, "en"), ("x y", "only")]
    docs = spark.createDataFrame([(i, t, l, "s", 1, "w") for i, (t, l) in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, word string").repartition(3)
    got = phrases.collocations(docs, least=5, first=None, shard_words=shard_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == _brute_phrases(rows, 5)


def test_a_shard_sends_at_most_a_row_a_word():
    """Phrases of 3 to 5 words: every occurrence is in one row, and a phrase's count is the sum over the rows that end with it."""
    rng = np.random.default_rng(6)
    text = rng.integers(1, 9, 400)
    seq = pa.table({"part": pa.array([0], pa.int32()), "ids": [phrases._pack(np.concatenate([[0], text]).astype(np.uint32))]})
    words = pa.table({"local": pa.array(range(1, 9), pa.int32()), "id": pa.array(range(11, 19), pa.int32())})

    class Everything:
        value = np.full(64, ~np.uint64(0))

    got = phrases._longer(Everything, 5)(seq, words)
    assert got.num_rows <= len(text) and sum(got["n"].to_pylist()) == len(text) - 2
    rows = [((r["a"] >> 32, r["a"] & 0xFFFFFFFF, r["b"], r["c"], r["d"]), r["n"]) for r in got.to_pylist()]
    for k in (3, 4, 5):
        want = collections.Counter(tuple(int(x) + 10 for x in text[i:i + k][::-1]) for i in range(len(text) - k + 1))
        have = collections.Counter()
        for w, n in rows:
            if w[k - 1]:
                have[w[:k]] += n
        assert have == want


def test_phrases_of_no_rows_and_first_ranks(spark, docs_of):
    assert phrases.collocations(docs_of(ODD).limit(0)).count() == 0
    rows = [(i, "red green blue red green. green blue") for i in range(10)]
    all_rows = {r["rank"]: r for r in phrases.collocations(docs_of(rows), least=3, first=None).collect()}
    two = phrases.collocations(docs_of(rows), least=3, first=2).collect()
    assert [all_rows[k] for k in (1, 2)] == sorted(two, key=lambda r: r["rank"])


def test_index_intervals_are_those_of_the_text():
    rng = np.random.default_rng(2)
    for kind in (np.uint16, np.uint32):
        s = np.concatenate([[0], rng.integers(0, 5, 400), [0]]).astype(kind)
        forth, back = phrases.Index(phrases.transform(s, 4)), phrases.Index(phrases.transform(s[::-1], 4))
        pair, n, low, other = phrases._two(forth, 5)
        want = collections.Counter((int(a), int(b)) for a, b in zip(s, s[1:]) if a and b)
        assert {tuple(p): k for p, k in zip(pair.tolist(), n.tolist())} == want
        p, sym, count, start, _ = forth.extended(low[(o := np.argsort(low))], n[o])
        three = collections.Counter((int(a), int(b), int(c)) for a, b, c in zip(s, s[1:], s[2:]) if a and b and c)
        assert {(int(x), *pair[o][i].tolist()): int(k) for i, x, k in zip(p, sym, count)} == three
        q, sym, count, _, less = back.extended(other[o], n[o])
        assert {(*pair[o][i].tolist(), int(x)): int(k) for i, x, k in zip(q, sym, count)} == three
        assert set((low[o][q] + less).tolist()) == set(start.tolist())


# ----------------------------------------------------------- hard negatives

def _brute_negatives(rows, every=10):
    rows = [(u, i, (l + 1) % 10 if i % 7 == 0 else l, np.floor(256 * np.array(v, float)).astype(int)) for u, (i, v, l) in enumerate(rows)
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(r[3]) for r in rows), default=0)
    rows = [(u, i, l, np.pad(x, (0, width - len(x)))) for u, i, l, x in rows]
    out = collections.Counter()
    for u, i, l, x in rows:
        if i % every:
            continue
        scored = sorted(((-int(x @ y), j, v, m) for v, j, m, y in rows if v != u))
        for s, j, *_ in [r for r in scored if r[3] == l][:5]:
            near = [(-t, k) for t, k, _, m in scored if m != l and 30 * -s <= 100 * -t <= 90 * -s][:10]
            for rank, (t, k) in enumerate(near, 1):
                out[(i, j, rank, k, -s, t)] += 1
    return out


@pytest.mark.parametrize("levels, part_rows", [((4, 16), 16_384), ((1, 3, 5), 3)])
def test_hard_negatives_equal_brute_force(spark, levels, part_rows):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 12))
    rows = [(int(i), (centre[i % 6] + 0.4 * rng.normal(size=12)).tolist(), int(rng.integers(0, 3))) for i in range(250)]
    rows += rows[:40] + [(10, rng.normal(size=12).tolist(), 1), (20, None, 1), (30, [1.0, None], 2), (40, [float("nan")] * 12, 0), (50, [1.0] * 12, None),
                         (None, [1.0] * 12, 1), (60, [0.5] * 5, 1), (70, [0.0] * 12, 2), (80, [], 1), (-100, [2.0] * 12, 2)]
    table = spark.createDataFrame([(i, v, l, 7, "x") for i, v, l in rows], "vec_id long, embedding array<double>, label int, uid long, score string").repartition(4)
    given = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (given + 1) % 10).otherwise(given)
    got = hard_negatives.mine(table, F.col("id") % 10 == 0, label, levels=levels, part_rows=part_rows)
    assert collections.Counter(tuple(r) for r in got.collect()) == _brute_negatives(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_no_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(none, F.col("id") % 10 == 0, F.col("label")).count() == 0


def test_bounds_hold_and_leave_pairs_out():
    rng = np.random.default_rng(8)
    x = rng.integers(-500, 500, (300, 32))
    x[:150] += 2000                                   # segments of like components: means decide
    for parts in (1, 4, 16):
        cut = hard_negatives.borders(32, parts)
        (m, d), n = hard_negatives.summary(x, cut), np.diff(cut)
        mid, reach, exact = (m * n) @ m.T, (d * n) @ d.T, x @ x.T
        assert (np.abs(exact - mid) <= reach + 1e-3).all()
    far = mid + reach < np.sort(exact, axis=1)[:, -5][:, None]
    assert far.mean() > 0.4
