"""Exact top-k by inner product, block at a time.

Vectors become integers: component x turns into floor(scale * x). Sorted by id and dealt into ranges, they are cut into
blocks of at most BLOCK vectors; a block is one row holding its forward index (ids and matrix) and, for each term
(dimension), the largest and smallest weight. For a query q a block's bound is the sum over terms of the larger of
q_d * max_d and q_d * min_d. Queries are cut into blocks of QUERIES in the same way.

A query walks the blocks of a slice (SLICE blocks) in descending order of its bounds, in rounds: the FIRST best blocks, then
GROWTH times as many each round, as long as bounds reach the k-th best score that all rounds before have found. As bounds
descend, the walk ends where none does: a block that is left out can't hold a better or equal score, so the result is
exact, ties included, after at most 1 + log(SLICE / FIRST) / log(GROWTH) rounds whatever the size of the table. Bounds
come from the table of block summaries, a few numbers for each BLOCK vectors; no task holds more than a slice of it.
Scores are products of integer
matrices, in doubles while every sum stays below 2**53, in 64-bit integers below 2**62 and in Python's integers beyond.

Defined cases: null vectors and vectors with null or non-finite components take no part; a component or a score that is
no 64-bit integer is an error, as in the SQL; vectors of another dimension than the query's aren't its candidates; repeated rows
are candidates and queries as often as they occur, but a query is never its own candidate (rows with the query's id are
left out); null ids take no part; fewer than k candidates give fewer rows; an empty table gives none; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import clashing, cut

BLOCK, QUERIES, FIRST, GROWTH, SLICE = 2048, 512, 2, 8, 4096
_LEAST = int(np.iinfo(np.int64).min)
_BLOCK_ROW = "block long, dim int, n int, ids binary, matrix binary, hi binary, lo binary"


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """id and v (array of long) of the vectors that take part."""
    v = clashing(vectors, ["vec_id", "embedding"]).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wide = lambda x: F.abs(x * F.lit(float(scale))) >= F.lit(2.0**63)
    whole = F.transform("e", lambda x: F.when(wide(x), F.raise_error(F.lit("a component is beyond 64 bits")).cast("long")).otherwise(F.floor(x * F.lit(float(scale)))))
    return v.where("id IS NOT NULL AND e IS NOT NULL").where(sound).select("id", whole.alias("v"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of rows(id, v) in ranges of ids; a block holds one dimension only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made, wait = TaskContext.get().partitionId(), 0, {}

        def block(dim: int) -> pd.DataFrame:
            nonlocal made
            ids, m = wait.pop(dim)
            matrix = np.array(m, np.int64).reshape(len(ids), dim)
            if matrix.min(initial=0) >= -(2**31) and matrix.max(initial=0) < 2**31:
                matrix = matrix.astype(np.int32)
            edge = (matrix.max(0), matrix.min(0))
            made += 1
            return pd.DataFrame([[part << 32 | made, dim, len(ids), np.array(ids, np.int64).tobytes(), matrix.tobytes(), edge[0].tobytes(), edge[1].tobytes()]], columns=["block", "dim", "n", "ids", "matrix", "hi", "lo"])

        for b in batches:
            for i, v in zip(b["id"], b["v"], strict=True):
                ids, m = wait.setdefault(len(v), ([], []))
                ids.append(i)
                m.append(v)
                if len(ids) == size:
                    yield block(len(v))
        for dim in list(wait):
            yield block(dim)

    spread = rows.repartitionByRange("id").sortWithinPartitions("id")
    return spread.mapInPandas(run, _BLOCK_ROW)


def _unpack(raw: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * n * dim else np.int64).reshape(n, dim)


def product(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """q @ m.T as exact integers: of 64 bits, or Python's where a sum may not fit."""
    if not q.shape[1]:
        return np.zeros((len(q), len(m)), np.int64)
    most = [max(float(x.max(initial=0)), -float(x.min(initial=0))) for x in (q, m)]
    top = most[0] * most[1] * q.shape[1]
    if top < 2**53:
        return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    kind = np.int64 if top < 2**62 else object
    return q.astype(kind) @ m.astype(kind).T


def bounds(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Largest possible score of each query (rows) in each block (columns)."""
    return product(np.maximum(q, 0), hi) + product(np.minimum(q, 0), lo)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each vector whose id meets is_query(id)."""
    rows = cut(integers(vectors, scale), "vectors")
    blocks = cut(_blocks(rows, BLOCK), "blocks")
    asked = cut(_blocks(rows.where(is_query), QUERIES).select(F.col("block").alias("asked"), "dim", F.col("ids").alias("qids"), F.col("matrix").alias("q")), "queries")
    # block summaries, a row for each slice
    summaries = blocks.select("dim", "block", "hi", "lo").join(blocks.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(SLICE)).alias("of")), "dim")
    summaries = cut(summaries.groupBy("dim", F.pmod(F.xxhash64("block"), F.col("of")).alias("slice")).agg(F.collect_list(F.struct("block", "hi", "lo")).alias("s")), "summaries")
    task = asked.join(summaries, "dim")

    def planned(begin: int, end: int):
        """(block, asked, rows of the query block): a query's blocks from place begin to end in order of bounds, those only
        whose bound reaches its k-th score."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    q = _unpack(r.q, r.dim, len(r.qids) // 8)
                    block = np.array([x["block"] for x in r.s], np.int64)
                    hi = np.vstack([_unpack(x["hi"], r.dim, 1) for x in r.s])
                    lo = np.vstack([_unpack(x["lo"], r.dim, 1) for x in r.s])
                    bound = bounds(q, hi, lo)
                    place = np.argsort(-bound, axis=1, kind="stable")[:, begin:end]
                    want = np.zeros(bound.shape, bool)
                    np.put_along_axis(want, place, True, axis=1)
                    if r.kth is not None:
                        need = np.frombuffer(r.kth, np.int64)[:, None]
                        want &= (bound >= need) | (need == _LEAST)
                    for j in np.flatnonzero(want.any(0)):
                        at = np.flatnonzero(want[:, j])
                        yield pd.DataFrame({"block": [block[j]], "asked": [r.asked], "rows": [at.astype(np.int32).tobytes()], "qids": [np.frombuffer(r.qids, np.int64)[at].tobytes()], "q": [q[at].tobytes()]})

        return run

    plan_row = "block long, asked long, rows binary, qids binary, q binary"

    def scored(plan: DataFrame) -> DataFrame:
        """asked, row, vec_id, score, block: the k best in each planned block for each of its planned queries."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    at, ids = np.frombuffer(r.rows, np.int32), np.frombuffer(r.ids, np.int64)
                    qids = np.frombuffer(r.qids, np.int64)
                    q = _unpack(r.q, r.dim, len(qids))
                    m = _unpack(r.matrix, r.dim, len(ids))
                    s = product(q, m)
                    own = qids[:, None] == ids[None, :]
                    # ids ascend in a block, so a stable order leaves ties to the smaller id
                    s_out = np.where(own, _LEAST if s.dtype != object else min(_LEAST, s.min()) - 1, s)
                    best = np.argsort(-s_out.astype(np.float64) if np.abs(s).max(initial=0) < 2**53 else ~s_out, axis=1, kind="stable")[:, :k]
                    fine = ~np.take_along_axis(own, best, 1)
                    row = np.broadcast_to(at[:, None], best.shape)[fine]
                    score = np.take_along_axis(s, best, 1)[fine]
                    if s.dtype == object and any(not _LEAST <= x < 2**63 for x in score):
                        raise ValueError("a score is beyond 64 bits")
                    yield pd.DataFrame({"asked": r.asked, "row": row, "query_id": np.broadcast_to(qids[:, None], best.shape)[fine], "vec_id": ids[best][fine], "score": score.astype(np.int64)})

        return plan.join(blocks.select("block", "dim", "ids", "matrix"), "block").mapInPandas(run, "asked long, row int, query_id long, vec_id long, score long")

    one = Window.partitionBy("asked", "row").orderBy(F.desc("score"), "vec_id")
    def lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k-th score of each query of a block; the least of all where fewer are known."""
        for b in batches:
            for r in b.itertuples(index=False):
                low = np.full(len(r.qids) // 8, _LEAST, np.int64)
                for x in r.known if r.known is not None else ():
                    if x["found"] >= k:
                        low[x["row"]] = x["low"]
                yield pd.DataFrame({"asked": [r.asked], "kth": [low.tobytes()]})

    longest = summaries.agg(F.max(F.size("s"))).first()[0] or 0
    best, state = None, asked.select("asked", F.lit(None).cast("binary").alias("kth"))
    begin, width = 0, FIRST
    while begin < longest:
        plan = cut(task.join(state, "asked").mapInPandas(planned(begin, begin + width), plan_row), "plan")
        if plan.isEmpty():
            break
        found = scored(plan) if best is None else best.unionByName(scored(plan))
        best = cut(found.withColumn("rank", F.row_number().over(one)).where(F.col("rank") <= k).drop("rank"), "best")
        kth = best.groupBy("asked", "row").agg(F.min("score").alias("low"), F.count("*").alias("found"))
        known = kth.groupBy("asked").agg(F.collect_list(F.struct("row", "low", "found")).alias("known"))  # QUERIES entries at most
        state = asked.select("asked", "qids").join(known, "asked", "left").mapInPandas(lowest, "asked long, kth binary")
        begin, width = begin + width, width * GROWTH
    if best is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", F.row_number().over(one).alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
