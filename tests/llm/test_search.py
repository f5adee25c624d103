"""Exact top-k search against all pairs."""

import math

import numpy as np
import pytest

from tenderflow.llm import queries, topk_search


def plain(rows, k, asked):
    out = []
    for q, v in rows:
        if asked(q):
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_table(spark, folder):
    rows = [(r.vec_id, [math.floor(256 * float(x)) for x in r.embedding]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert found(queries.op5_topk_search(spark, folder)) == plain(rows, 5, lambda i: i % 50 == 0)


@pytest.mark.parametrize("spread", [0, 1, 50])
def test_ties_and_blocks(spark, spread):
    rng = np.random.default_rng(spread)
    rows = [(i, rng.integers(-spread, spread + 1, 6).tolist()) for i in range(400)]
    v = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    assert found(topk_search.topk(v, v.where("vec_id % 50 = 0"), 5, block=90)) == plain(rows, 5, lambda i: i % 50 == 0)


@pytest.mark.parametrize("dims,decay,most", [(4, 1.0, 0.5), (64, 0.5, 0.5)])
def test_the_threshold_stops_the_scan(dims, decay, most):
    """Where few dimensions carry the product, a small share is scored, and the result is that of all pairs."""
    rng = np.random.default_rng(7)
    v = np.floor(256 * rng.normal(0, 1, (4000, dims)) * decay ** np.arange(dims)).astype(np.int64)
    ids, asked, scored = np.arange(4000), np.arange(0, 4000, 200), []
    rows = topk_search.block_topk(ids, v, asked, v[asked], 5, scored=scored)
    for q in asked:
        s = v @ v[q]
        assert [(i, x) for a, i, x in rows if a == q] == [(i, s[i]) for i in sorted(set(ids) - {q}, key=lambda i: (-s[i], i))[:5]]
    assert sum(scored) < most * 4000 * len(asked)


def test_repeated_vectors(spark):
    """Repeated candidate rows each count, repeated query rows are asked once."""
    v = spark.createDataFrame([(0, [2, 1]), (0, [2, 1]), (1, [3, 0]), (1, [3, 0]), (2, [0, 1])], "vec_id long, v array<bigint>")
    assert found(topk_search.topk(v, v.where("vec_id = 0"), 3)) == [(0, 1, 1, 6), (0, 2, 1, 6), (0, 3, 2, 1)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], "x"), (1, None, "x"), (2, [], "x"), (3, [1.0, None], "x"), (4, [nan, 1.0], "x"), (5, [inf, 1.0], "x"), (6, [-0.001, 2.0], "x"), (7, [1.0], "x"), (None, [1.0, 1.0], "x")]
    v = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string"))
    assert sorted((r.vec_id, r.v) for r in v.collect()) == [(0, [256, 128]), (6, [-1, 512]), (7, [256])]
    assert found(topk_search.topk(v, v, 5)) == [(0, 1, 6, 256 * -1 + 128 * 512), (6, 1, 0, 256 * -1 + 128 * 512)]
    assert topk_search.topk(v.limit(0), v.limit(0), 5).count() == 0


def test_large_components():
    """Products beyond 2**53 and 2**63 are exact, and what does not fit a long is an error."""
    ids, one = np.arange(3), np.array([9])
    v = np.array([[2**31, 1], [2**31 + 1, -1], [2**33, -(2**33)]])
    q = np.array([[2**31, 2**31]])
    assert topk_search.block_topk(ids, v, one, q, 3) == [(9, 0, 2**62 + 2**31), (9, 1, 2**62), (9, 2, 0)]
    with pytest.raises(OverflowError):
        topk_search.block_topk(ids, v[2:, :1] * 2**20, one, q[:, :1], 3)
