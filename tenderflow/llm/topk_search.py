"""Exact top-k inner-product search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors become integers floor(256 x). Candidates are dealt into blocks of at most about BLOCK vectors by a hash of
their id; a block keeps, for every dimension, its vectors in order of that component. A query reads lists from the end
that helps it, those first whose frontier adds most to the threshold, in growing runs; it scores what it has not seen,
and stops when the threshold (the sum of the frontier's contributions) is below its kth score; on equality it reads on,
as a smaller id may still win. The first block's kth score is a floor in all other blocks. The best k of each block are
merged by rank. How much of a block is scored depends on the data: where few dimensions carry most of the product,
little; where 64 unlike dimensions weigh the same, no threshold of sorted lists can rule much out and almost all is.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of another
length than the query's are no candidates of it; equal scores go to the smaller vec_id; repeated candidate rows each count, repeated query
rows are asked once, and rows that share a query id share its k results. Products beyond 2**53 are computed in whole
numbers, and a score that does not fit a long raises an error. Empty tables give no rows; only vec_id and embedding are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenderflow.llm.storage import written

BLOCK = 16_384
#: Most queries (about) that one task answers; more are dealt into chunks, each of which meets every block.
CHUNK = 4_096
#: Entries of a list that a query reads before its first look at the threshold; each further run is twice as long.
RUN = 16
SCHEMA = "query_id long, vec_id long, score long"


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 x) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where((F.size(x) > 0) & whole)
    return rows.select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * 256)).cast("array<long>").alias("v"))


def block_topk(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None, scored: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best of one block for each query; those below a query's floor may be left out.

    Only the lists whose frontier still adds most to the threshold are read on, so that lists which cannot decide
    anything stay unread. `scored` receives how many candidates each query scored.
    """
    n, dims = v.shape
    # the largest product that may come up, in Python's integers: floats are exact below 2**53, longs below 2**63
    most = max(map(abs, (int(v.max(initial=0)), int(v.min(initial=0))))) * max(map(abs, (int(queries.max(initial=0)), int(queries.min(initial=0))))) * dims
    if most >= 2**63:
        v, queries = v.astype(object), queries.astype(object)
    lists = np.argsort(v, axis=0, kind="stable").T
    ordered = np.take_along_axis(v, lists.T, axis=0).T
    middle = ordered[:, n // 2]
    exact = v.astype(np.float64) if most < 2**53 else v
    out = []
    for query_id, q, floor in zip(query_ids, queries, [None] * len(queries) if floors is None else floors, strict=True):
        used = np.flatnonzero(q)
        up = q[used] > 0
        usual = middle[used] * q[used]
        depth = np.zeros(len(used), np.int64)
        seen = np.zeros(n, bool)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step, count = RUN, 0
        while not seen.all():
            edge = np.where(up, ordered[used, n - 1 - depth], ordered[used, depth]) * q[used]
            # unseen candidates stand no better in any list than its frontier; on equality a smaller id may still win
            least = best[-1] if len(best) == k else None
            least = floor if least is None or (floor is not None and floor > least) else least
            if least is not None and depth.any() and int(edge.sum()) < least:
                break
            fresh = np.zeros(n, bool)
            if len(used):
                gain = edge - usual
                for d in np.argsort(-gain, kind="stable")[: max(1, len(used) // 4)]:
                    end = min(depth[d] + step, n)
                    fresh[lists[used[d], n - end : n - depth[d]] if up[d] else lists[used[d], depth[d] : end]] = True
                    depth[d] = min(end, n - 1)
                step *= 2
            else:
                fresh[:] = True
            fresh &= ~seen
            seen |= fresh
            rows = np.flatnonzero(fresh)
            rows = rows[ids[rows] != query_id]
            count += len(rows)
            if len(rows):
                # a score beyond a long is an error, never another number
                scores = np.array((exact[rows] @ q.astype(exact.dtype)).tolist(), object).astype(np.int64) if most >= 2**63 else (exact[rows] @ q.astype(exact.dtype)).astype(np.int64)
                best_ids, best = np.concatenate([best_ids, ids[rows]]), np.concatenate([best, scores])
                order = np.lexsort((best_ids, -best))[:k] if len(best) <= 4 * k else _first(best_ids, best, k)
                best_ids, best = best_ids[order], best[order]
        if scored is not None:
            scored.append(count)
        out += [(int(query_id), int(i), int(s)) for i, s in zip(best_ids, best, strict=True)]
    return out


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
    near = np.flatnonzero(scores >= kth)
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors (vec_id, v) for each row of queries, but its own id."""
    queries = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    blocks, chunks = -(-max(vectors.count(), 1) // block), -(-max(queries.count(), 1) // CHUNK)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def one_of(n: int, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    dealt = vectors.withColumn("block", one_of(blocks, "vec_id")).withColumn("chunk", every(chunks))
    asked = queries.withColumn("chunk", one_of(chunks, "query_id")).withColumn("floor", F.lit(None).cast("long"))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for size, own in right.groupby(right["q"].map(len)):
            there = left[left["v"].map(len) == size]
            if len(there):
                floors = np.array([None if pd.isna(x) else int(x) for x in own["floor"]], object)
                out += block_topk(there["vec_id"].to_numpy(), np.stack(there["v"].to_list()), own["query_id"].to_numpy(), np.stack(own["q"].to_list()), k, floors)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def search(dealt: DataFrame, asked: DataFrame) -> DataFrame:
        return dealt.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInPandas(run, SCHEMA)

    found = search(dealt.where("block = 0"), asked.withColumn("block", F.lit(0)))
    if blocks > 1:
        # the kth score in the first block is a floor for all others
        found = written(found, "first-block")
        kth = F.when(F.count("*") >= k, F.element_at(F.sort_array(F.collect_list("score"), False), k))
        floors = found.groupBy("query_id").agg(kth.alias("floor"))
        rest = asked.drop("floor").join(floors, "query_id", "left").withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))))
        found = found.unionByName(search(dealt.where("block > 0"), rest))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
