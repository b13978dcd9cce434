"""Merkle manifest of a dataset: a tree per source, a tree over the sources, a proof per row.

Leaves are numbered within their source and dealt to partitions: aligned runs of
``fanout ** levels`` leaves.  A partition hashes its own subtree.  Then the partitions exchange
like a butterfly: in round r those that share a parent subtree and the place inside their own
subtree swap the roots of their subtrees (at most ``fanout`` rows meet), and each hashes the
parent by itself.  Ancestors are hashed once per partition below them, and every partition ends
with the siblings of its whole way up, so no pass leads down again.  Where the last subtree is
short, its partitions also write to the places that it lacks.  The roots of the sources are
exchanged in the same way, one row per source, and leaves meet their partition's way up to
become proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from convlytics.llm.common import cut, forget, map_arrow, runs, written
from convlytics.llm.ranks import met, numbered

FANOUT, LEVELS = 16, 2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<before:string,after:string>>"
_ROWS_OUT = 1_000


def leaf_of(*values: Column) -> Column:
    """Digest of a row: each value by its byte count and itself, a NULL as a dash."""
    said = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _parents(nodes: list[str], fanout: int) -> tuple[list[str], list[str]]:
    """The runs of a level, concatenated, and their digests."""
    joined = ["".join(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return joined, [hashlib.sha256(x.encode()).hexdigest() for x in joined]


def _height(size: int, fanout: int, levels: int) -> int:
    """Levels of a partition's own tree: all of them unless the whole source is smaller."""
    height = 0
    while height < levels and fanout**height < size:
        height += 1
    return height


def _subtrees(fanout: int, levels: int):
    """(source, partition, size, node) of partitions whose rows arrive in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            found.clear()
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["source", "partition", "leaves", "node"])

        for (source, part), rows in runs(batches, ["source", "partition"]):
            nodes, size = rows.column("leaf").to_pylist(), rows.column("leaves")[0].as_py()
            for _ in range(_height(size, fanout, levels)):
                _, nodes = _parents(nodes, fanout)
            found.append((source, part, size, nodes[0]))
            if len(found) == _ROWS_OUT:
                yield packed()
        if found:
            yield packed()

    return run


def _butterfly(nodes: DataFrame, keys: list[str], fanout: int) -> DataFrame:
    """``nodes`` (keys, ``at``, ``of``, ``node``) with ``node`` the root of its group and ``way`` the siblings up to it.

    ``at`` is the place among the ``of`` nodes of the group.  A round is one shuffle of a row
    per node (and per missing place) and one join by the same keys.
    """
    state, path = written(nodes.withColumn("way", F.array().cast(PROOF)), "butterfly")
    most, span = state.agg(F.max("of")).first()[0] or 0, 1
    while span < most:
        subtree = F.floor(F.col("at") / F.lit(span)).cast("long")
        places = state.withColumns({"subtree": subtree, "lane": F.col("at") % span}).withColumn("parent", F.floor(F.col("subtree") / F.lit(fanout)).cast("long"))
        here = F.least(F.lit(span), F.col("of") - F.col("subtree") * span)
        letters = places.filter(F.col("of") > span).select(*keys, "parent", "subtree", "node", F.explode(F.sequence(F.col("lane"), F.lit(span - 1).cast("long"), here)).alias("lane"))
        run = letters.groupBy(*keys, "parent", "lane").agg(F.array_sort(F.collect_list(F.struct("subtree", "node"))).alias("run"))
        active = F.col("of") > span
        own = (F.col("subtree") % fanout).cast("int")
        kept = F.transform("run", lambda x: x["node"])
        step = F.struct(F.array_join(F.slice(kept, F.lit(1), own), "").alias("before"), F.array_join(F.slice(kept, own + 2, F.lit(fanout)), "").alias("after"))
        now = met(places, run, [*keys, "parent", "lane"], "left", only=active).withColumns({
            "node": F.when(active, F.sha2(F.array_join(kept, "").cast("binary"), 256)).otherwise(F.col("node")),
            "way": F.when(active, F.concat("way", F.array(step))).otherwise(F.col("way")).cast(PROOF),
        }).select(*state.columns)
        state, new = written(now, "butterfly")
        forget(state.sparkSession, path)
        path, span = new, span * fanout
    return state


def _proofs(fanout: int, levels: int, schema: pa.Schema):
    """Leaves with the siblings inside their partition and then those of its way up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        waiting = 0
        for _, rows in runs(batches, ["source", "partition"]):
            rows = rows.combine_chunks()
            way = [(s["before"], s["after"]) for s in rows.column("way")[0].as_py()]  # the partition's own row is the first
            subroot, root = rows.column("subroot")[0], rows.column("root")[0]
            rows = rows.slice(1)
            leaves, size = rows.column("leaf").to_pylist(), rows.column("leaves")[0].as_py()
            paths: list[list[tuple[str, str]]] = [[] for _ in leaves]
            nodes, width = leaves, 1
            for _ in range(_height(size, fanout, levels)):
                joined, parents = _parents(nodes, fanout)
                for i, path in enumerate(paths):
                    at = i // width
                    run, j = joined[at // fanout], 64 * (at % fanout)
                    path.append((run[:j], run[j + 64 :]))
                nodes, width = parents, width * fanout
            n, steps = len(leaves), len(paths[0]) + len(way)
            flat = [s for path in paths for s in (*path, *way)]
            befores, afters = zip(*flat, strict=True) if flat else ((), ())
            proof = pa.ListArray.from_arrays(
                pa.array([i * steps for i in range(n + 1)], pa.int32()),
                pa.StructArray.from_arrays([pa.array(befores, pa.string()), pa.array(afters, pa.string())], names=["before", "after"]),
            ).cast(schema.field("proof").type)
            made = {"proof": proof, "subroot": pa.array([subroot.as_py()] * n, pa.string()), "root": pa.array([root.as_py()] * n, pa.string())}
            held.append(pa.Table.from_arrays([made[f.name] if f.name in made else rows.column(f.name) for f in schema], schema=schema))
            waiting += n
            if waiting >= _ROWS_OUT:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, waiting = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return run


def manifest(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = COLUMNS,
    also: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """One row per document: ``source, doc_id, position, leaf, subroot, root, proof`` and what ``also`` names.

    ``columns`` enter the leaf in their order.  ``proof`` lists, from the leaf to the root, the
    digests before and after the node in its run; `folded` gives the root back.  ``also`` adds
    string columns of the document (a claimed digest, say).

    NULLs in any column are a dash; a NULL source is a source of its own, before all others; NULL
    ids come first; empty and very long texts are hashed whole.  Rows with equal ids are ordered by
    their digest; rows that repeat whole are leaves of their own.  A lone leaf is the root of its
    source, and a lone source's root is the root of all.  An empty table gives no row.  Other
    columns are not read.
    """
    spark, also = docs.sparkSession, also or {}
    value = {c: F.col(f"`{c}`") for c in columns}
    rows = docs.select(F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("doc_id"), leaf_of(*value.values()).alias("leaf"), *(c.alias(k) for k, c in also.items()))
    leaves = numbered(cut(rows, "leaves"), ["source"], ["doc_id", "leaf"], "position", "leaves")
    leaves = cut(leaves.withColumn("partition", F.floor(F.col("position") / fanout**levels).cast("long")), "numbered")

    own = leaves.select("source", "partition", "position", "leaves", "leaf").repartition("source", "partition").sortWithinPartitions("source", "partition", "position")
    subtrees = map_arrow(own, _subtrees(fanout, levels), "source string, partition long, leaves long, node string")
    parts = subtrees.select("source", F.col("partition").alias("at"), F.ceil(F.col("leaves") / fanout**levels).cast("long").alias("of"), "node")
    parts = _butterfly(parts, ["source"], fanout).withColumnRenamed("node", "subroot")

    sources = numbered(parts.filter("at = 0").select("source", F.col("subroot").alias("node")), [], ["source"], "at", "of")
    sources = _butterfly(sources, [], fanout).select("source", F.col("node").alias("root"), F.col("way").alias("upper"))
    ways = met(parts, sources, ["source"]).select("source", F.col("at").alias("partition"), F.concat("way", "upper").alias("way"), "subroot", "root")

    nothing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in leaves.schema.fields}
    ways = ways.select(*(F.col(c) if c in ("source", "partition") else F.lit(-1).cast("long").alias(c) if c == "position" else nothing[c] for c in leaves.columns), "way", "subroot", "root")
    with_ways = leaves.withColumns({"way": F.lit(None).cast(PROOF), "subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string")}).unionByName(ways)
    dealt = with_ways.repartition("source", "partition").sortWithinPartitions("source", "partition", "position")
    schema = dealt.select("source", "doc_id", "position", "leaf", *also, "subroot", "root", F.col("way").alias("proof")).schema
    return map_arrow(dealt, _proofs(fanout, levels, to_arrow_schema(schema)), schema)
