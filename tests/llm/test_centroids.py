import hashlib
import math
import random

from convlytics.llm import centroids


def brute(rows, dim, k, rounds):
    """(vec_id, cluster, distance) per vector, and the centroids, by plain integers."""
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) and abs(x) < 2**17 for x in e)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    middle = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(middle)), key=lambda c: (far(v, middle[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        middle = [[sum(xs) // len(groups[c]) for xs in zip(*groups[c], strict=True)] if c in groups else m for c, m in enumerate(middle)]
    return sorted(((i, nearest(v), far(v, middle[nearest(v)])) for i, v in kept), key=str), middle


def compare(spark, rows, *, dim, k=8, rounds=10):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    frame = frame.withColumns({c: frame["vec_id"].cast("string") for c in ("v", "x", "dots", "cluster", "score", "n", "sums")})
    placed, found = centroids.cluster(frame, dim=dim, k=k, rounds=rounds)
    want, middle = brute(rows, dim, k, rounds)
    got = placed.collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    assert found.tolist() == middle
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for *_, d in want)


def test_random_vectors(spark):
    dice = random.Random(1)
    compare(spark, [(i, [dice.gauss(0, 1) + 3 * (i % 5) for _ in range(6)]) for i in range(400)], dim=6)


def test_awkward_vectors(spark):
    dice = random.Random(2)
    rows = [(i, [dice.choice([-0.5, 0.0, 0.25, 1e4, -7.3]) for _ in range(3)]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [math.nan, 0.0, 1.0]), (105, [math.inf, 0.0, 1.0]), (106, [1e30, 0.0, 0.0])]
    same = [(7, [0.5, 0.5, 0.5])] * 5 + [(None, [0.1, 0.2, 0.3])] * 3
    compare(spark, rows + odd + same, dim=3)
    compare(spark, same, dim=3, rounds=2)  # equal centroids: all but the first stay empty
    compare(spark, rows[:5], dim=3)  # fewer vectors than centroids


def test_nothing(spark):
    placed, found = centroids.cluster(spark.createDataFrame([], "vec_id bigint, embedding array<double>"))
    assert placed.collect() == [] and len(found) == 0
    assert set(placed.columns) >= {"vec_id", "cluster", "distance", "cluster_inertia", "inertia"}
