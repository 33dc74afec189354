"""Personal data by weak supervision.

Fixed patterns give the base spans, which always stay. Looser patterns give
further candidates (numbers that fail a check, national phone numbers,
spelled-out addresses, titled or listed names). Labelers of three sorts
(patterns and check sums, gazetteers, context words) vote for, against or
not at all on each candidate. Expectation-maximisation over the counts of
vote patterns of the whole corpus estimates how reliable each labeler is for
each kind, without labels; its posteriors then train a logistic span
classifier over shape and context features, and candidates it rates
``ADD_AT`` or higher are added.

Edge cases: null and empty texts have no spans; added spans never overlap
base spans; repeated rows get equal results; an empty table gives no rows
(and the prior decides); the masking filter passes all other columns through.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passage.llm._common import materialise, over_texts, slices, text_or_empty
from passage.llm.spans import Span, flagged, joined, masked, sha256

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("email_like", "ip_like", "number", "phone_like", "name")
LABELERS = ("pattern", "check", "gazetteer", "before", "after", "shape")
ADD_AT = 0.9
#: Candidates used to fit the span classifier.
SAMPLE_SPANS = 20_000
SIZE = 1 << 12
CONTEXT = 32
EM_ROUNDS = 100

# base patterns (fixed values); possessive repeats give the same matches in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# candidates beyond the base
_SPELLED = re.compile(r"[A-Za-z0-9._-]{2,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,64} ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,10}")
_NATIONAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Mme|Madame|Monsieur)\.? [A-Z][a-zà-ÿ]{1,30}(?: [A-Z][a-zà-ÿ]{1,30})?")
# what a text must hold, for a linear-time search
_NEEDS = {
    "email": r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9]([\x20-]?[0-9]){11}",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "email_like": r"[(\[]at[)\]]", "phone_like": r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "title": r"(Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Se\x{f1}ora?|Mme|Madame|Monsieur)\.? [A-Z]",
}

# gazetteers (fixed values)
FIRST_NAMES = frozenset("""James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica
Thomas Sarah Charles Karen Daniel Lisa Matthew Nancy Anthony Betty Mark Margaret Paul Sandra Steven Ashley Andrew Emily Kevin Donna Brian Michelle
Hans Peter Klaus Wolfgang Ursula Monika Petra Sabine Pierre Jean Michel Marie Nathalie Isabelle José Antonio Manuel Carmen María Ana Juan Luis Carlos""".split())
_LISTED = re.compile(r"\b(?:%s) [A-Z][a-zà-ÿ]{1,30}\b" % "|".join(sorted(FIRST_NAMES)))
# the search's word boundary is ASCII, so names beyond ASCII stand without it
_NEEDS["name"] = r"(\b(%s)|%s) [A-Z]" % tuple("|".join(sorted(n for n in FIRST_NAMES if n.isascii() == a)) for a in (True, False))
TOP_DOMAINS = frozenset("com org net edu gov info biz io co uk de fr es it nl eu us ca ch at".split())
FOR_WORDS = {
    "email": ("mail", "contact", "write", "kontakt", "courriel", "correo"), "ip": ("ip", "host", "server", "address", "login", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment", "account"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "telefon", "appel"), "name": ("name", "dear", "signed", "by", "called"),
}
AGAINST_WORDS = ("version", "v.", "isbn", "issn", "page", "order", "invoice", "chapter", "section", "build", "release", "serial", "#")
_FAMILY = {"email": "email", "ip": "ip", "card": "card", "phone": "phone", "email_like": "email", "ip_like": "ip", "number": "card", "phone_like": "phone", "name": "name"}


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Every '@' with the run of local characters before it, bounded by the match before, and a dotted domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1) if at else None
        a = at
        if m:
            while a > free and text[a - 1] in _LOCAL:
                a -= 1
        if m and a < at:
            out.append(("email", a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str, need: dict[str, bool]) -> tuple[list[Span], list[Span]]:
    """Base spans, and the matches of their patterns that failed a check (as candidates)."""
    good: list[Span] = _emails(text) if need["email"] else []
    loose: list[Span] = []
    if need["ip"]:
        for m in _IP.finditer(text):
            ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
            (good if ok else loose).append(("ip" if ok else "ip_like", m.start(), m.end()))
    if need["card"]:
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19:
                ok = luhn(d)
                (good if ok else loose).append(("card" if ok else "number", m.start(), m.end()))
    if need["phone"]:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                good.append(("phone", m.start(), m.end()))
    return good, loose


def candidates(text: str, need: dict[str, bool]) -> tuple[list[Span], list[Span]]:
    """Base spans and further candidates that overlap none of them."""
    base, more = base_spans(text, need)
    if need["email_like"]:
        more += [("email_like", m.start(), m.end()) for m in _SPELLED.finditer(text)]
    if need["phone_like"]:
        more += [("phone_like", m.start(), m.end()) for m in _NATIONAL.finditer(text)]
    if need["title"]:
        more += [("name", m.start(), m.end()) for m in _TITLED.finditer(text)]
    if need["name"]:
        more += [("name", m.start(), m.end()) for m in _LISTED.finditer(text)]
    taken = sorted((a, e) for _, a, e in base)
    out, last = [], -1
    for k, a, e in sorted(more, key=lambda s: (s[1], -s[2])):
        i = np.searchsorted([t[0] for t in taken], e) - 1 if taken else -1
        if a >= last and not (i >= 0 and taken[i][1] > a):
            out.append((k, a, e))
            last = e
    return base, out


def votes(text: str, span: Span) -> tuple[int, ...]:
    """1 for, -1 against, 0 no vote, in the order of LABELERS."""
    kind, a, e = span
    family, s, d = _FAMILY[kind], text[a:e], _digits(text[a:e])
    before, after = text[max(0, a - CONTEXT):a].lower(), text[e:e + CONTEXT].lower()
    pattern = 1 if kind in BASE else 0
    if kind == "name":
        pattern = 1 if _TITLED.match(s) else 0
    if family == "email":
        check = 1 if len(s) <= 254 and ".." not in s else -1
        gaz = 1 if s.rsplit(".", 1)[-1].lower() in TOP_DOMAINS else -1
    elif family == "ip":
        check = 1 if kind == "ip" else -1
        gaz = -1 if s.split(".")[0] in ("0", "127", "255") else 0
    elif family == "card":
        check = 1 if kind == "card" else -1
        gaz = 1 if d[:1] in "3456" else -1
    elif family == "phone":
        check = 1 if 9 <= len(d) <= 15 else -1
        gaz = 1 if s.startswith("+") and d[:1] != "0" else 0
    else:
        check = 0
        gaz = 1 if FIRST_NAMES & set(s.split()) else -1
    words = FOR_WORDS[family]
    ahead = -1 if any(w in before for w in AGAINST_WORDS) else (1 if any(w in before for w in words) else 0)
    behind = 1 if any(w in after for w in words) else 0
    shape = -1 if d and (len(set(d)) <= 2 or d in "01234567890123456789") else (1 if family in ("email", "name") or len(set(d)) >= 4 else 0)
    return pattern, check, gaz, ahead, behind, shape


def shape_features(text: str, span: Span) -> np.ndarray:
    """Hashed features of a span: kind, shape, length, character classes around it, nearby words."""
    kind, a, e = span
    s = text[a:e]
    shape = re.sub(r"[a-zà-ÿ]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}", s)))[:24]
    fs = [f"k={kind}", f"s={kind}{shape}", f"n={kind}{min(e - a, 40)}", f"d={kind}{min(len(_digits(s)), 20)}",
          f"p={kind}{text[a - 1:a]}", f"f={kind}{text[e:e + 1]}", f"h={kind}{s[:2]}"]
    fs += [f"w={kind}{w}" for w in re.findall(r"\w+", text[max(0, a - CONTEXT):a].lower())[-3:] + re.findall(r"\w+", text[e:e + CONTEXT].lower())[:2]]
    return np.array(sorted({zlib.crc32(f.encode()) % SIZE for f in fs}), np.int64)


@dataclass
class SpanModel:
    reliability: dict[str, list[tuple[float, float, float, float]]]  # kind -> labeler -> P(for|real), P(against|real), P(for|not), P(against|not)
    weights: np.ndarray
    bias: float

    def probability(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[f].sum() + self.bias, -30, 30))))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]]):
    """EM of a two-class model with independent labelers for each kind.

    ``patterns``: kind, votes and how often they occur. Starts from labelers
    that are mostly right, which also fixes which class is the real one, and
    keeps a prior count on each parameter so rare kinds stay near it.
    Returns reliabilities and the posterior of every pattern."""
    start = np.array([[0.6, 0.1, 0.1, 0.6]] * len(LABELERS))
    strength = 20.0
    reliability, posterior = {}, {}
    for kind in KINDS:
        rows = [(v, n) for k, v, n in patterns if k == kind]
        par, prior = start.copy(), 0.5
        if rows:
            v, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
            hit, miss = (v == 1).astype(float), (v == -1).astype(float)
            for _ in range(EM_ROUNDS):
                def like(f, g):
                    rest = np.maximum(1 - par[:, f] - par[:, g], 1e-6)
                    return (hit @ np.log(par[:, f]) + miss @ np.log(par[:, g]) + (1 - hit - miss) @ np.log(rest))
                real, no = like(0, 1) + np.log(prior), like(2, 3) + np.log(1 - prior)
                q = 1 / (1 + np.exp(np.clip(no - real, -50, 50)))
                wr, wn = n * q, n * (1 - q)
                prior = float(np.clip((wr.sum() + strength / 2) / (n.sum() + strength), 0.01, 0.99))
                new = np.stack([(wr @ hit + strength * start[:, 0]) / (wr.sum() + strength), (wr @ miss + strength * start[:, 1]) / (wr.sum() + strength),
                                (wn @ hit + strength * start[:, 2]) / (wn.sum() + strength), (wn @ miss + strength * start[:, 3]) / (wn.sum() + strength)], 1)
                if np.abs(new - par).max() < 1e-6:
                    break
                par = np.clip(new, 1e-3, 0.998)
            posterior |= {(kind, r[0]): float(x) for r, x in zip(rows, q)}
        reliability[kind] = [tuple(map(float, p)) for p in par]
    return reliability, posterior


def _needs(col: pa.Array) -> dict[str, np.ndarray]:
    return {k: flagged(col, p) for k, p in _NEEDS.items()}


def _each(b: pa.RecordBatch):
    """Rows with candidates: number, text, base spans, further candidates."""
    col = b.column(b.schema.get_field_index("text"))
    need = _needs(col)
    for i in np.flatnonzero(np.any(list(need.values()), axis=0)).tolist():
        text = col[i].as_py()
        base, more = candidates(text, {k: bool(v[i]) for k, v in need.items()})
        if base or more:
            yield i, text, base, more


def candidate_table(docs: DataFrame) -> DataFrame:
    """kind, votes and features of every candidate of the corpus."""
    def run(batches):
        for b in slices(batches):
            kind, vote, feat = [], [], []
            for _, text, base, more in _each(b):
                for s in base + more:
                    kind.append(s[0])
                    vote.append(list(votes(text, s)))
                    feat.append(shape_features(text, s).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(vote, pa.list_(pa.int32())), pa.array(feat, pa.list_(pa.int32()))],
                                             names=["kind", "votes", "features"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "kind string, votes array<int>, features array<int>")


def fit_pii(docs: DataFrame) -> SpanModel:
    """Reliabilities from the vote counts of all candidates; classifier from a bounded sample of them."""
    table = candidate_table(docs)
    # one pass: candidates with equal kind, votes and features are one row with a count
    seen = table.groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
    seen = materialise(seen, "pii")
    rows = seen.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()  # at most kinds * 3**labelers
    patterns = sorted((r.kind, tuple(r.votes), r.n) for r in rows)
    reliability, posterior = estimate(patterns)
    sample = seen.orderBy(F.xxhash64("kind", "votes", "features"), "kind", "votes", "features").limit(SAMPLE_SPANS).collect()
    w, bias = _fit_spans([(np.array(r.features), posterior[r.kind, tuple(r.votes)], r.n) for r in sample])
    return SpanModel(reliability, w, bias)


def _fit_spans(rows: list[tuple[np.ndarray, float, int]]) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels (AdaGrad over batches)."""
    w, g2, bias, b2 = np.zeros(SIZE), np.full(SIZE, 1e-2), 0.0, 1e-2
    rng = np.random.default_rng(5)
    for _ in range(400 if rows else 0):
        pick = rng.integers(0, len(rows), min(256, len(rows)))
        p = np.concatenate([rows[i][0] for i in pick])
        who = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
        y = np.array([rows[i][1] for i in pick])
        z = np.bincount(who, w[p], len(pick)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(pick)
        grad = np.bincount(p, err[who], SIZE) + 1e-4 * w
        g2 += grad * grad
        w -= 0.5 * grad / np.sqrt(g2)
        b2 += err.sum() ** 2
        bias -= 0.5 * err.sum() / np.sqrt(b2)
    return w, float(bias)


def _added(text: str, more: list[Span], model: SpanModel) -> list[Span]:
    return [s for s in more if model.probability(shape_features(text, s)) >= ADD_AT]


def scan(docs: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document."""
    def run(batches):
        nothing = sha256("")
        for b in slices(batches):
            n = b.num_rows
            counts = {k: np.zeros(n, np.int64) for k in BASE}
            digest, listed = [nothing] * n, [""] * n
            for i, text, base, more in _each(b):
                for k, _, _ in base:
                    counts[k][i] += 1
                digest[i] = sha256(joined(base, KINDS))
                listed[i] = joined(base + _added(text, more, model), KINDS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(counts[k]) for k in BASE), pa.array(digest), pa.array(listed)],
                                             names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def mask(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``n_chars``, if there, follows the text."""
    def run(col: pa.Array) -> pa.Array:
        b, texts = pa.RecordBatch.from_arrays([col], names=["text"]), None
        for i, text, base, more in _each(b):
            texts = texts or col.to_pylist()
            texts[i] = masked(text, base + _added(text, more, model), lambda k: f"<{k}>")
        return col if texts is None else pa.array(texts, pa.string())

    text = F.arrow_udf(over_texts(run, pa.string()), "string")
    out = docs.withColumn("text", text(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
