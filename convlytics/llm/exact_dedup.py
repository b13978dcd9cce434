"""Exact duplicates by Patricia tries over length-and-content-hash partitions.

Every input task first folds its own rows in a small trie, so a text that fills a third of
the input leaves each task once.  The distinct byte strings then meet in partitions of
their length and content hash, where a second trie holds them whole: equality is decided
byte by byte, never by a hash.  Terminals carry the owner (longest original, then smallest
id) and the number of rows.  A trie that outgrows its budget spills by subtree: the largest
branch below the root is emitted as partial terminals and freed, and a last aggregation
over the digests merges partial terminals of one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlytics.llm.common import in_pieces, map_arrow

#: Characters that do not count when texts are compared.
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of labels that one trie may hold before it spills a subtree.
TRIE_BYTES = 32 << 20
_PIECE_BYTES = 2 << 20


class _Node:
    __slots__ = ("branches", "label", "owner")

    def __init__(self, label: bytes, owner: list | None = None):
        self.label, self.owner, self.branches = label, owner, {}


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (points, id) the longer original, then the smaller id; a missing id comes last."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


class PatriciaTrie:
    """Compressed radix trie over byte strings whose terminals are ``[points, id, rows]``."""

    def __init__(self, most_bytes: int = TRIE_BYTES):
        self.root, self.most_bytes = _Node(b""), most_bytes
        self.held: dict[int, int] = {}  # bytes of labels below each branch of the root

    def insert(self, key: bytes, points: int, doc: int | None, rows: int) -> None:
        node, at, first = self.root, 0, key[0] if key else -1
        while at < len(key):
            below = node.branches.get(key[at])
            if below is None:
                node.branches[key[at]] = _Node(key[at:], [points, doc, rows])
                self.held[first] = self.held.get(first, 0) + len(key) - at + 200
                return
            same = _common(below.label, key, at)
            if same < len(below.label):
                fork = _Node(below.label[:same])
                below.label = below.label[same:]
                fork.branches[below.label[0]] = below
                node.branches[key[at]] = fork
                below = fork
                self.held[first] = self.held.get(first, 0) + 200
            node, at = below, at + same
        if node.owner is None:
            node.owner = [points, doc, rows]
        else:
            node.owner[:2] = _better((node.owner[0], node.owner[1]), (points, doc))
            node.owner[2] += rows

    def full(self) -> bool:
        return sum(self.held.values()) > self.most_bytes

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Take the largest subtree below the root out of memory."""
        first = max(self.held, key=self.held.get)
        del self.held[first]
        yield from self._terminals(self.root.branches.pop(first))

    def drain(self) -> Iterator[tuple[bytes, list]]:
        root, self.root = self.root, _Node(b"")
        self.held.clear()
        yield from self._terminals(root)

    @staticmethod
    def _terminals(top: _Node) -> Iterator[tuple[bytes, list]]:
        stack = [(top, b"")]
        while stack:
            node, path = stack.pop()
            path += node.label
            if node.owner is not None:
                yield path, node.owner
            stack.extend((below, path) for below in node.branches.values())


_FOLDED = pa.schema([("body", pa.binary()), ("points", pa.int64()), ("owner", pa.int64()), ("rows", pa.int64())])
_OWNED = pa.schema([("text_sha256", pa.string()), ("points", pa.int64()), ("owner", pa.int64()), ("rows", pa.int64())])


def _through_trie(digest: bool, most_bytes: int):
    """Rows of byte strings to one row for each terminal of the partition's trie."""

    def batch(found: list[tuple[bytes, list]]) -> pa.RecordBatch:
        keys = [hashlib.sha256(k).hexdigest() if digest else k for k, _ in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string() if digest else pa.binary()), *(pa.array([o[i] for _, o in found], pa.int64()) for i in range(3))],
            schema=_OWNED if digest else _FOLDED,
        )

    def packed(found: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for key, owner in found:
            held.append((key, owner))
            size += len(key) + 100
            if size > _PIECE_BYTES:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(most_bytes)
        for piece in in_pieces(batches, "body", _PIECE_BYTES):
            for row in zip(*(piece.column(c).to_pylist() for c in ("body", "points", "owner", "rows")), strict=True):
                trie.insert(*row)
            while trie.full():
                yield from packed(trie.spill())
        yield from packed(trie.drain())

    return run


def normal_bytes(text: Column) -> Column:
    """What is compared: the text without blanks, NULL as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _digest(text: Column) -> Column:
    return F.sha2(F.encode(normal_bytes(text), "UTF-8"), 256)


def text_owners(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: ``text_sha256, keep_id, group_size``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.encode(normal_bytes(F.col(text_col)), "UTF-8").alias("body"),
        F.length(text).cast("long").alias("points"),
        F.col(id_col).cast("long").alias("owner"),
        F.lit(1).cast("long").alias("rows"),
    )
    folded = map_arrow(rows, _through_trie(False, trie_bytes // 2), "body binary, points long, owner long, rows long")
    dealt = folded.repartition(F.octet_length("body"), F.xxhash64("body"))
    owned = map_arrow(dealt, _through_trie(True, trie_bytes), "text_sha256 string, points long, owner long, rows long")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("owner").isNull().alias("none"), F.col("owner").alias("owner")))
    return owned.groupBy("text_sha256").agg(best.alias("best"), F.sum("rows").alias("group_size")).select("text_sha256", F.col("best.owner").alias("keep_id"), "group_size")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without blanks; of equal texts the one with the most code
    points stays, then the smallest id.  NULL texts count as empty and form one group with
    empty and blank texts.  A NULL id stays only where its group has no other; repeated rows
    (same id and text) are members like others and are all marked as kept if their id stays.
    An empty table gives an empty result; other columns are not read, whatever their names.
    """
    owners = text_owners(docs, id_col=id_col, text_col=text_col, trie_bytes=trie_bytes)
    members = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(F.col(text_col)).alias("text_sha256"))
    return members.join(owners, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text no better row holds; all columns as they came."""
    kept = exact_duplicates(docs, id_col=id_col, text_col=text_col).filter("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__kept_id")) & (_digest(F.col(text_col)) == F.col("__kept_sha"))
    return docs.join(kept, same, "left_semi")
