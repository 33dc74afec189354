"""Registered queries of this subpackage (and their SQL where SQL can express them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passage.llm import hard_negatives, knn, mixing, near_dup, packing, phrases, pii, quality, retrieval_packing, secret_scan, suffix_dedup, token_orc, toxicity
from passage.llm._common import new_path, read_table
from passage.llm.byte_tokens import byte_tokenizer
from passage.llm.tokens import word_tokenizer


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    costs = toxicity.char_model(docs)
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"), costs)
    return toxicity.score_documents(docs, model, costs)


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token_orc")
    token_orc.write_tokens(read_table(spark, sf_dir, "documents"), path, word_tokenizer())
    return token_orc.digests(token_orc.read_tokens(spark, path))


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.clusters(read_table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read_table(spark, sf_dir, "documents")).drop("shards")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secret_scan.scan(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.fit_pii(docs))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), word_tokenizer())


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op11_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.pack_related(read_table(spark, sf_dir, "documents"), byte_tokenizer())


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every seventh id carries a wrong label
    given = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (given + 1) % 10).otherwise(given)
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_token_orc, op3_bagminhash, op4_source_mix, op5_secret_scan, op6_pii, op7_quality_rules, op8_best_fit_packing, op9_suffix_dedup, op10_voronoi_topk,
                            op11_retrieval_packing, op12_phrase_mining, op13_hard_negatives)
}
SQL: dict[str, str] = {
    "op10_voronoi_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_phrase_mining": r"""
WITH w AS (SELECT doc, lang, piece, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (
             SELECT doc, lang, piece, string_split_regex(trim(line, ' ' || chr(9)), '[ \t]+') AS words FROM (
               SELECT doc, lang, unnest(lines) AS line, generate_subscripts(lines, 1) AS piece FROM (
                 SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS lines FROM documents) t) t
             WHERE trim(line, ' ' || chr(9)) <> '') t),
s AS (SELECT lang, unnest([1, 2, 3, 4, 5]) AS d, [word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p, lead(word, 4) OVER p] AS ws
      FROM w WINDOW p AS (PARTITION BY doc, piece ORDER BY pos)),
f AS (SELECT lang, d, list_slice(ws, 1, d) AS ws, count(*) AS f FROM s WHERE ws[d] IS NOT NULL GROUP BY ALL),
tot AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE d = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE d >= 2 AND f >= 100),
longer AS (SELECT lang, ws, max(f) AS g FROM (SELECT lang, list_slice(ws, 1, d - 1) AS ws, f FROM c WHERE d > 2 UNION ALL SELECT lang, list_slice(ws, 2, d), f FROM c WHERE d > 2) t GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer x ON x.lang = c.lang AND x.ws = c.ws WHERE x.g IS NULL OR x.g < c.f),
cuts AS (SELECT lang, ws, f AS a, d, unnest(range(1, d)) AS k FROM kept),
sc AS (SELECT cuts.*, x.f AS l, y.f AS r, tot.n, (1000::HUGEINT * a * tot.n) // (x.f::HUGEINT * y.f) AS score
       FROM cuts JOIN f x ON x.lang = cuts.lang AND x.ws = list_slice(cuts.ws, 1, k) JOIN f y ON y.lang = cuts.lang AND y.ws = list_slice(cuts.ws, k + 1, cuts.d) JOIN tot ON tot.lang = cuts.lang),
best AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best) t WHERE rank <= 2000""",
    "op13_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.u AS au, a.vec_id AS anchor_id, c.u, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.u <> c.u),
p AS (SELECT au, u AS pu, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY au ORDER BY score DESC, vec_id, u) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.au, p.pu ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.au = p.au AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
