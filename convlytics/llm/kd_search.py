"""Exact top-k by inner product with one KD-tree per shard.

Vectors are dealt to shards of bounded size by a hash of their id; a task builds the tree of a
shard (median splits along the widest side, tight boxes) and writes it as one row.  Queries
travel in blocks.  A pilot search in one shard gives every query a k-th score; it goes along to
all other shards, where branches are visited best bound first and left out once their box can't
reach it.  Each shard returns k rows for a query at most, and ties are kept by id.

The work grows with queries times vectors, which the task asks for; what is shuffled is every
shard once and every block of queries once for each shard.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convlytics.llm.common import cut, map_arrow, runs

SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 8192, 128, 256
_NONE = np.iinfo(np.int64).min
_ROWS = "dim long, shard long, kind int, ids binary, matrix binary, best binary"


class KdTree:
    """Median splits over integer vectors; node i has a box, two children or a range of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        self.low, self.high, self.below, self.span = [], [], [], []
        stack = [(0, len(ids), -1)]
        while stack:
            start, end, parent = stack.pop()
            node, own = len(self.low), vectors[order[start:end]]
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            self.below.append([])
            self.span.append((start, end))
            if parent >= 0:
                self.below[parent].append(node)
            if end - start > LEAF_ROWS:
                side = int((self.high[node] - self.low[node]).argmax())
                middle = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(own[:, side], middle)]
                stack += [(start, start + middle, node), (start + middle, end, node)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, reach: float) -> tuple[np.ndarray, np.ndarray, float]:
        """(ids, scores, k-th score) of the k best rows with a score of at least ``reach``."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < reach:
                break
            if self.below[node]:
                for child in self.below[node]:
                    if bounds[child] >= reach:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            start, end = self.span[node]
            found = self.vectors[start:end] @ query
            good = (found >= reach) & (self.ids[start:end] != own)
            if good.any():
                ids, scores = np.concatenate([ids, self.ids[start:end][good]]), np.concatenate([scores, found[good]])
                first = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[first], scores[first]
                if len(ids) == k:
                    reach = max(reach, scores[-1])
        return ids, scores, reach


def _exact(vectors: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats where every sum is exact in 53 bits, else as Python's integers."""
    top = lambda x: int(max(-int(x.min()), int(x.max()), 1)) if x.size else 1
    kind = np.float64 if top(vectors) * top(other) * max(1, vectors.shape[1]) < 1 << 53 else object
    return vectors.astype(kind), other.astype(kind)


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, dim)


def _gathered(kind: int):
    """The rows of each (dim, shard) in order of id as one row; of repeated ids the first counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, shard), rows in runs(batches, ["dim", "shard"]):
            ids, first = np.unique(np.array(rows["id"].to_pylist(), np.int64), return_index=True)
            vectors = np.array(rows["vector"].combine_chunks().flatten(), np.int64).reshape(-1, dim)[first]
            yield _row(dim, shard, kind, ids, vectors, np.full(len(ids), _NONE))

    return run


def _row(dim: int, shard: int, kind: int, ids: np.ndarray, vectors: np.ndarray, best: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    data = {"dim": pa.array([dim], pa.int64()), "shard": pa.array([shard], pa.int64()), "kind": pa.array([kind], pa.int32())}
    for name, values in {"ids": ids, "matrix": vectors, "best": best, **more}.items():
        data[name] = pa.array([np.ascontiguousarray(values, np.int64).tobytes()], pa.binary())
    return pa.RecordBatch.from_pydict(data)


def _searched(k: int, pilot: bool):
    """Partitions sorted by (dim, shard, kind): each shard's tree, then its blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tree = None, None
        for batch in batches:
            for row in batch.to_pylist():
                dim, shard = row["dim"], row["shard"]
                ids, vectors = np.frombuffer(row["ids"], np.int64), _matrix(row["matrix"], dim)
                if row["kind"] == 0:
                    place, tree, kept = (dim, shard), None, (ids, vectors)
                    continue
                best = np.frombuffer(row["best"], np.int64).copy()
                out: list[list] = [[], [], []]
                if place == (dim, shard):
                    points, queries = _exact(kept[1], vectors)
                    if tree is None or tree.vectors.dtype != points.dtype:
                        tree = KdTree(kept[0], points)
                    # The largest product with any point of a node's box, for all queries at once.
                    bounds = np.maximum(queries, 0) @ tree.high.T + np.minimum(queries, 0) @ tree.low.T
                    for i, own in enumerate(ids):
                        found, scores, reach = tree.search(queries[i], bounds[i], int(own), k, best[i] if best[i] != _NONE else -math.inf)
                        out[0] += [int(own)] * len(found)
                        out[1] += found.tolist()
                        out[2] += [int(s) for s in scores]
                        if reach > -math.inf:
                            best[i] = int(reach)
                hits = [np.array(x, np.int64) for x in out]
                if pilot:
                    yield _row(dim, shard, 1, ids, vectors, best, q=hits[0], v=hits[1], s=hits[2])
                elif out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in hits], names=["query_id", "vec_id", "score"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for q, v, s in zip(*(batch.column(c).to_pylist() for c in "qvs"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (q, v, s)], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best other rows by integer inner product.

    A component x counts as floor(scale * x); ties go to the smaller id.  Vectors that are
    NULL, empty, or hold NULL or non-finite components, and rows with a NULL id, take no part;
    vectors of other lengths than the query's are no candidates; of repeated ids one row
    counts.  A query without candidates has no rows, nor has an empty table.  Components and
    scores must fit 64 bits.
    """
    value = F.col(vector_col)
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = (
        vectors.filter(F.col(id_col).isNotNull() & value.isNotNull() & (F.size(value) > 0) & F.coalesce(fine, F.lit(False)))
        .select(F.col(id_col).cast("long").alias("id"), is_query.alias("asks"), F.transform(value, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"))
        .withColumn("dim", F.size("vector").cast("long"))
    )
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).first()
    shards, blocks = max(1, -(-sizes["n"] // shard_rows)), max(1, -(-sizes["asks"] // block_rows))
    deal = lambda df, n, salt: df.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n).cast("long")))
    order = ["dim", "shard"]
    gather = lambda df, kind: map_arrow(df.select("dim", "shard", "id", "vector").repartition(*order).sortWithinPartitions(*order, "id"), _gathered(kind), _ROWS)
    trees = cut(gather(deal(rows, shards, 0), 0), "shards")
    asked = cut(gather(deal(rows.filter("asks"), blocks, 1), 1), "queries")

    def search(of: DataFrame, pilot: bool, schema: str) -> DataFrame:
        met = trees.union(of).repartition(*order).sortWithinPartitions(*order, "kind")
        return map_arrow(met, _searched(k, pilot), schema)

    at = F.col("shard") % shards
    piloted = cut(search(asked.withColumn("shard", at), True, f"{_ROWS}, q binary, v binary, s binary"), "piloted")
    others = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), lambda x: x != F.col("shard")))
    sent = piloted.select("dim", others.alias("shard"), "kind", "ids", "matrix", "best")
    hits = search(sent, False, "query_id long, vec_id long, score long").union(map_arrow(piloted.select("q", "v", "s"), _unpacked, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
