import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlytics.llm import kd_search
from convlytics.llm.kd_search import KdTree


def brute(rows, every, k=5, scale=256):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v])
    out = []
    for i, q in good.items():
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good.items() if j != i and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(frame, every, **more):
    return sorted(tuple(r) for r in kd_search.top_k(frame, F.col("vec_id") % every == 0, **more).collect())


def test_real_vectors_in_small_shards(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in frame.collect()], 20)
    assert found(frame, 20, shard_rows=64, block_rows=3) == want
    assert found(frame, 20) == want


@pytest.fixture(scope="module")
def odd(spark):
    """Ties, repeated rows, two lengths, what takes no part, and clashing names."""
    random.seed(1)
    rows = [(i, [random.choice([-0.5, 0.0, 0.25, 0.251]) for _ in range(3 if i % 3 else 4)]) for i in range(120)]
    rows += rows[:10] + [(200, None), (201, []), (202, [0.1, None, 0.2]), (203, [0.1, float("nan"), 0.2]), (204, [float("inf"), 0.0, 0.0]), (None, [0.1, 0.2, 0.3]), (210, [0.5] * 7)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return rows, frame.withColumns({c: F.lit(1) for c in ("id", "dim", "shard", "kind", "vector", "rank", "score", "asks", "best")})


@pytest.mark.parametrize(("shard_rows", "block_rows"), [(8192, 256), (9, 2), (1, 1)])
def test_odd_rows(odd, shard_rows, block_rows):
    rows, frame = odd
    assert found(frame, 10, shard_rows=shard_rows, block_rows=block_rows) == brute(rows, 10)


def test_empty_table_and_no_queries(odd):
    assert found(odd[1].limit(0), 10) == []
    assert found(odd[1], 100_000) == [r for r in brute(odd[0], 100_000)]


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(-(2**21) + 3 * i)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert found(frame, 7) == brute(rows, 7)


def test_boxes_are_tight_and_bound_their_rows():
    random.seed(2)
    vectors = np.array([[random.randint(-50, 50) for _ in range(6)] for _ in range(900)], np.float64)
    tree = KdTree(np.arange(900), vectors)
    for node, (start, end) in enumerate(tree.span):
        own = tree.vectors[start:end]
        assert (own.min(axis=0) == tree.low[node]).all() and (own.max(axis=0) == tree.high[node]).all()
        query = np.array([random.randint(-50, 50) for _ in range(6)], np.float64)
        bound = np.maximum(query, 0) @ tree.high[node] + np.minimum(query, 0) @ tree.low[node]
        assert (own @ query).max() <= bound
