"""Exact top-k inner products by a Voronoi join.

1. Vectors become integers; pivots are the ``_pivots(n)`` vectors with the
   smallest id hashes, one an id; every vector joins the cell of its nearest
   pivot.
2. Cell summaries (rows, largest distance to the pivot) bound all scores:
   q.x <= q.p + |q| * radius for x in the cell of p. The pivots are vectors of
   the table, so the k+1 highest of q's scores with them bound q's k-th best
   from below (k+1, as one may be the query itself); cells that fill up k+1
   rows by their lower bounds q.p - |q| * radius do the same. Where the
   query's id is repeated, k + its number of rows are filled, and pivots of
   its own id don't count (pivots have distinct ids).
3. Queries are grouped by cell into parts of at most ``QUERY_ROWS``; a part
   needs the cells whose upper bound reaches some query's lower bound, and
   only those are replicated to it, in chunks of about ``CHUNK_ROWS`` by hash.
4. Each (part, chunk) is solved locally by blocks; the k best of every chunk
   meet by query.

Large or repeated cells are dealt by hash like any other, so no task holds a
whole cell, and no candidate is dropped that could be among the k best.

Edge cases: vectors that are null, hold a null or a non-finite component, and
rows with a null id take no part; a shorter vector counts as padded with
zeros; rows with the query's own id aren't its candidates; repeated query ids
are answered once, by the row whose vector sorts first; ties go to the
smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passage.llm._common import materialise

K = 5
SCALE = 256
MAX_PIVOTS = 256
QUERY_ROWS = 16_384
CHUNK_ROWS = 16_384
#: Queries scored against a chunk at once.
BLOCK = 256


def _pivots(n: int) -> int:
    return max(1, min(MAX_PIVOTS, int(math.sqrt(n))))


def _parse(scale: int):
    def run(batches):
        for b in batches:
            ids, vecs = [], []
            for i, v in zip(b.column("id").to_pylist(), b.column("vec")):
                a = v.values
                if i is None or a is None or a.null_count:
                    continue
                x = np.floor(scale * np.asarray(a, np.float64))
                if np.isfinite(x).all():
                    ids.append(i)
                    vecs.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], names=["id", "vec"])
    return run


def integer_vectors(table: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """id and the vector floor(scale * x) as little-endian 64-bit integers."""
    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(_parse(scale), "id long, vec binary")


def _matrix(col, dim: int) -> np.ndarray:
    out = np.zeros((len(col), dim), np.int64)
    for i, v in enumerate(col.to_pylist()):
        x = np.frombuffer(v, "<i8")
        out[i, :len(x)] = x
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows: in double precision where every partial sum fits, else in integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _nearest(pivots: np.ndarray):
    norms = (pivots.astype(np.float64) ** 2).sum(1)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("vec"), pivots.shape[1]).astype(np.float64)
            d2 = (x ** 2).sum(1)[:, None] - 2 * x @ pivots.T.astype(np.float64) + norms
            cell = d2.argmin(1) if len(x) else np.zeros(0, np.int64)
            dist = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(cell.astype(np.int32)), pa.array(dist)], names=["id", "vec", "cell", "dist"])
    return run


def _needs(pivots: np.ndarray, ids: np.ndarray, rows: np.ndarray, radius: np.ndarray, k: int):
    """Which cells each query needs; ``ids`` are the pivots' and ``own`` the number of rows with the query's id."""
    p = pivots.astype(np.float64)
    used = rows > 0

    def run(batches):
        for b in batches:
            x = _matrix(b.column("vec"), p.shape[1]).astype(np.float64)
            if not len(x):
                continue
            dot, norm = x @ p.T, np.sqrt((x ** 2).sum(1))[:, None]
            slack = 1e-6 * (np.abs(dot) + norm * radius) + 1e-3  # rounding never loses a cell
            upper, lower = dot + norm * radius + slack, np.where(used, dot - norm * radius - slack, -np.inf)
            order = np.argsort(-lower, axis=1)
            filled = np.cumsum(rows[order], axis=1) >= k + np.asarray(b.column("own"))[:, None]
            at = filled.argmax(1)
            bound = np.where(filled.any(1), np.take_along_axis(lower, np.take_along_axis(order, at[:, None], 1), 1)[:, 0], -np.inf)
            if len(p) >= k:
                other = np.where(np.asarray(b.column("id"))[:, None] == ids, -np.inf, dot)
                bound = np.maximum(bound, np.partition(other, -k, axis=1)[:, -k] - 1e-3)
            need = used & (upper >= bound[:, None])
            part = np.asarray(b.column("part"))
            for q in np.unique(part):
                cells = np.flatnonzero(need[part == q].any(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), q, np.int64)), pa.array(cells.astype(np.int32))], names=["part", "cell"])
    return run


def _solve(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if queries.num_rows and rows.num_rows:
            dim = max(len(v) for col in (queries["vec"], rows["vec"]) for v in col.to_pylist()) // 8
            ids = np.asarray(rows["id"])
            by = np.argsort(ids, kind="stable")
            ids, x = ids[by], _matrix(rows["vec"], dim)[by]
            qid, q = np.asarray(queries["id"]), _matrix(queries["vec"], dim)
            low = np.iinfo(np.int64).min
            for a in range(0, len(qid), BLOCK):
                s = _products(q[a:a + BLOCK], x)
                own = qid[a:a + BLOCK, None] == ids[None, :]
                s[own] = low
                kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), low)
                for i in range(len(s)):
                    over = np.flatnonzero(s[i] > kth[i])
                    tie = np.flatnonzero(s[i] == kth[i])[:k] if kth[i] > low else over[:0]
                    pick = np.concatenate([over, tie])
                    pick = pick[np.lexsort((ids[pick], -s[i][pick]))][:k]
                    out_q.append(np.full(len(pick), qid[a + i]))
                    out_v.append(ids[pick])
                    out_s.append(s[i][pick])
        cat = lambda xs: pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64), pa.int64())
        return pa.table({"query_id": cat(out_q), "vec_id": cat(out_v), "score": cat(out_s)})
    return run


def top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE,
          query_rows: int = QUERY_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` highest inner products of every query.

    ``is_query`` is a condition on the column ``id``."""
    spark = table.sparkSession
    schema = "query_id long, vec_id long, score long"
    vectors = materialise(integer_vectors(table, id_col, vec_col, scale), "vectors")
    n = vectors.count()
    chosen = [r.id for r in vectors.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(_pivots(n)).collect()]  # at most MAX_PIVOTS ids
    first = vectors.where(F.col("id").isin(chosen)).groupBy("id").agg(F.min("vec").alias("vec")).orderBy("id").collect()
    width = (vectors.agg(F.max(F.length("vec"))).first()[0] or 0) // 8
    if not n or not width:
        empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        return empty
    pivots = np.zeros((len(first), width), np.int64)
    for i, r in enumerate(first):
        v = np.frombuffer(bytes(r.vec), "<i8")
        pivots[i, :len(v)] = v
    cells = materialise(vectors.mapInArrow(_nearest(pivots), "id long, vec binary, cell int, dist double"), "cells")
    rows, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    ask = np.zeros(len(pivots), np.int64)
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r"), F.count_if(is_query).alias("q")).collect():  # a row a cell
        rows[r.cell], radius[r.cell], ask[r.cell] = r.n, r.r, r.q
    # queries of near cells form a part; a cell with more than QUERY_ROWS queries is split by hash
    before = np.concatenate([[0], np.cumsum(ask)])
    lo = before[:-1] // query_rows
    width_of = np.maximum((before[1:] - 1) // query_rows - lo + 1, 1)
    base = F.array(*[F.lit(int(x)) for x in lo])[F.col("cell")]
    spread = F.array(*[F.lit(int(x)) for x in width_of])[F.col("cell")]
    part = (base + F.pmod(F.xxhash64("id"), spread)).cast("long")
    # one answer for an id: the row with the smallest vector
    queries = cells.where(is_query).groupBy("id").agg(F.min(F.struct("vec", "cell")).alias("v"), F.count("*").alias("own")).select("id", "v.vec", "v.cell", "own")
    queries = materialise(queries.withColumn("part", part), "queries")
    need = queries.mapInArrow(_needs(pivots, np.array([r.id for r in first], np.int64), rows, radius, k), "part long, cell int").distinct()
    chunks = max(1, -(-n // chunk_rows))
    chunk = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(chunks))
    there = cells.join(need, "cell").select("part", chunk.alias("chunk"), "id", "vec")
    asked = queries.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "id", "vec")
    near = asked.groupBy("part", "chunk").cogroup(there.groupBy("part", "chunk")).applyInArrow(_solve(k), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
