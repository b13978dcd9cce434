"""Centroid clustering of integer vectors with persisted dot products.

Every vector carries its exact dot product with every centroid.  When centroids move, a task adds
``change * component`` for the components that changed and nothing else; the squared distance is
``|v|^2 - 2 v.c + |c|^2``, so the nearest centroid follows from the products alone.  A round is a
map over the table of the round before, written to the shared folder, and one aggregate of a row
per task and cluster; what reaches the driver are the sums of ``k`` clusters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlytics.llm.common import forget, map_arrow, written

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3:"
#: Scaled components from here on don't fit the arithmetic of long distances.
_LIMIT = 1 << 27
_STATE = "vec_id long, v array<int>, dots array<long>, cluster int, score long"


def scaled(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` of the vectors that take part: ``dim`` finite components, scaled and floored."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).filter(F.size("x") == dim)
    # NaN is larger than any number, so the bounds refuse it as they do the infinities.
    rows = rows.filter(F.forall("x", lambda c: c.isNotNull() & (c < _LIMIT / scale) & (c >= -_LIMIT / scale)))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _rows(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _moved(change: np.ndarray, centroids: np.ndarray):
    """Products after ``change`` of the centroids, and the nearest one (the first of equals)."""
    k, dim = centroids.shape
    norms = (centroids**2).sum(1)
    parts = [(c, np.flatnonzero(change[c])) for c in range(k) if change[c].any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), dim)
            dots = _matrix(batch.column("dots"), k) if "dots" in batch.schema.names else np.zeros((len(v), k), np.int64)
            for c, at in parts:
                dots[:, c] += v[:, at] @ change[c, at]
            far = norms - 2 * dots
            near = far.argmin(1)
            score = far[np.arange(len(v)), near]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), _rows(dots, pa.int64()), pa.array(near, pa.int32()), pa.array(score, pa.int64())],
                names=["vec_id", "v", "dots", "cluster", "score"],
            )

    return run


def _sums(k: int, dim: int):
    """Vectors and component sums by cluster, one row per task and cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                near = batch.column("cluster").to_numpy()
                np.add.at(sums, near, _matrix(batch.column("v"), dim))
                counts += np.bincount(near, minlength=k)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met]), _rows(sums[met], pa.int64())], names=["cluster", "n", "sums"])

    return run


def _centres(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Floored means of the clusters; an empty one stays."""
    k, dim = before.shape
    parts = map_arrow(state.select("v", "cluster"), _sums(k, dim), "cluster int, n long, sums array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[j]) for j in range(dim))).alias("sums")).collect()
    after = before.copy()
    for row in rows:
        after[row.cluster] = np.array(row.sums, np.int64) // row.n
    return after


def cluster(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, k: int = CLUSTERS, rounds: int = ROUNDS,
    scale: int = SCALE, seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, v, cluster, distance, cluster_inertia, inertia`` per vector that takes part, and the centroids.

    Centroids start as the ``k`` vectors whose id has the smallest digest behind ``seed`` (ties, as by
    repeated ids: the smaller components; a NULL id counts as empty text).  Fewer vectors give as
    many centroids.  NULL vectors, other lengths, NULL, NaN and infinite components take no part, nor do
    components of 2^27 or more after scaling, whose distances don't fit a long.  Repeated rows are
    vectors of their own; a tie goes to the smaller cluster.  An empty table gives no row.  Other
    columns are not read.
    """
    spark = vectors.sparkSession
    base, path = written(scaled(vectors, id_col=id_col, vector_col=vector_col, dim=dim, scale=scale), "vectors")
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = base.orderBy(order, "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dim)
    if not first:
        return base.select("vec_id", "v", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long")))), centroids
    state, change = base, centroids
    for turn in range(rounds + 1):
        state, new = written(map_arrow(state.select([c for c in ("vec_id", "v", "dots") if c in state.columns]), _moved(change, centroids), _STATE), "products")
        forget(spark, path)
        path = new
        if turn < rounds:
            moved = _centres(state, centroids)
            change, centroids = moved - centroids, moved
            if not change.any():  # nothing moves any more
                break
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    placed = state.select("vec_id", "v", "cluster", (norm + F.col("score")).alias("distance"))
    spread = {r.cluster: r.d for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    by_cluster = [spread.get(c, 0) for c in range(len(centroids))]
    return placed.withColumns({"cluster_inertia": per_cluster(by_cluster).cast("long"), "inertia": F.lit(sum(by_cluster)).cast("long")}), centroids


def per_cluster(values: list) -> Column:
    """The value of a row's cluster, from one per cluster."""
    return F.array(*map(F.lit, values))[F.col("cluster")]


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()
