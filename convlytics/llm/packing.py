"""Vector bin packing of token sequences by the dot-product heuristic.

Every task packs the rows of its own partition, so no token is shuffled and a lost executor
costs its tasks only.  A task keeps a bounded pool of waiting pieces and fills one sequence at
a time: of the pieces that fit under all three limits (tokens, segments, loss-bearing tokens)
it takes the one whose demand has the largest dot product with what is left of the sequence,
each dimension weighted by the pool's demand for it.  What still remains is filled by cutting
a waiting piece, so only the last sequence of a task has more than a few padded places.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlytics.llm.common import in_pieces, map_arrow
from convlytics.llm.word_bpe import chunk_ids

#: The id behind the last token of every document.
END_ID = 2
_PIECE_BYTES = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """Per sequence: tokens, segments and loss-bearing tokens; ``least`` is the shortest cut."""

    tokens: int = 4096
    segments: int = 128
    loss: int = 4096
    least: int = 16
    pool: int = 512


#: Whole documents: as many segments as a sequence has tokens.
DOCUMENTS = Limits(segments=4096)


class VectorPacker:
    """Packs (id, ids, loss_from): from token ``loss_from`` on, tokens bear loss."""

    def __init__(self, limits: Limits, first_id: int):
        self.limits, self.next_id = limits, first_id
        self.items: list[list] = []  # id, ids, start, end, loss_from, doc_tokens
        # Pieces wait until they are many and can fill two sequences: each has a token at least.
        most = max(limits.pool, 2 * limits.tokens)
        self.tokens = np.zeros(most, np.float64)
        self.loss = np.zeros(most, np.float64)
        self.waiting = 0

    def _take(self, item: list, tokens: int, loss: int) -> int:
        """How many of the item's next tokens fit."""
        start, end, loss_from = item[2], item[3], item[4]
        free = max(0, loss_from - start)  # bear no loss
        return min(end - start, tokens, free + loss)

    def _piece(self, item: list, length: int, sequence: int, offset: int) -> tuple:
        doc, ids, start, _, loss_from, total = item
        item[2] = start + length
        self.waiting -= length
        return doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, self._bearing(start, start + length, loss_from), sequence, offset

    @staticmethod
    def _bearing(start: int, end: int, loss_from: int) -> int:
        return max(0, end - max(start, loss_from))

    def _measure(self, i: int) -> None:
        _, _, start, end, loss_from, _ = self.items[i]
        self.tokens[i], self.loss[i] = end - start, self._bearing(start, end, loss_from)

    def _ample(self) -> bool:
        """Enough waits for full sequences: by tokens, or by what segments allow."""
        return self.waiting >= 2 * self.limits.tokens or len(self.items) >= 2 * self.limits.segments

    def add(self, doc, ids: bytes, loss_from: int) -> Iterator[tuple]:
        total = len(ids) // 4
        item = [doc, ids, 0, total, loss_from, total]
        while total - item[2] > self.limits.tokens or self._bearing(item[2], total, loss_from) > self.limits.loss:
            length = self._take(item, self.limits.tokens, self.limits.loss)
            if length == self.limits.tokens:
                self.waiting += length
                yield self._piece(item, length, self.next_id, 0)
                self.next_id += 1
            else:  # the loss limit ends this piece: it shares a sequence
                yield from self._wait([doc, ids, item[2], item[2] + length, loss_from, total])
                item[2] += length
        yield from self._wait(item)

    def _wait(self, item: list) -> Iterator[tuple]:
        self.items.append(item)
        self.waiting += item[3] - item[2]
        self._measure(len(self.items) - 1)
        if len(self.items) >= self.limits.pool:
            while len(self.items) > self.limits.pool // 2 and self._ample():
                yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        while self.items:
            yield from self._fill()

    def _fill(self) -> Iterator[tuple]:
        """One sequence out of the waiting pieces."""
        most = self.limits
        n = len(self.items)
        tokens, loss = self.tokens[:n], self.loss[:n]
        left = [most.tokens, most.segments, most.loss]
        by_tokens = tokens.mean() / most.tokens**2
        by_segments = 1 / most.segments**2
        by_loss = loss.mean() / most.loss**2
        open_, offset, used = np.ones(n, bool), 0, []
        while left[1]:
            fits = open_ & (tokens <= left[0]) & (loss <= left[2])
            score = np.where(fits, tokens * (by_tokens * left[0] / most.tokens) + loss * (by_loss * left[2] / most.loss) + by_segments * left[1] / most.segments, -1.0)
            i = int(score.argmax())
            if not fits[i]:
                break
            length = int(tokens[i])
            left = [left[0] - length, left[1] - 1, left[2] - int(loss[i])]
            yield self._piece(self.items[i], length, self.next_id, offset)
            offset += length
            open_[i] = False
            used.append(i)
        if left[1] and left[0] >= most.least and open_.any():
            i = int(np.where(open_, tokens, -1).argmax())
            length = self._take(self.items[i], left[0], left[2])
            length = min(length, int(tokens[i]) - most.least)
            if length >= most.least:
                yield self._piece(self.items[i], length, self.next_id, offset)
                self._measure(i)
        self.next_id += 1
        for i in sorted(used, reverse=True):  # the last waiting piece takes the place of the one that went
            last = len(self.items) - 1
            self.items[i] = self.items[last]
            self.tokens[i], self.loss[i] = self.tokens[last], self.loss[last]
            self.items.pop()


def _pack(columns: list[str], encode: Callable[..., Iterator[tuple[bytes, int]]], limits: Limits):
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows = VectorPacker(limits, TaskContext.get().partitionId() << 36), []
        for piece in in_pieces(batches, columns[-1], _PIECE_BYTES):
            docs, *texts = (piece.column(c).to_pylist() for c in columns)
            for doc, (ids, loss_from) in zip(docs, encode(*texts), strict=True):
                rows.extend(packer.add(doc, ids, loss_from))
            if rows:
                yield out(rows)
                rows = []
        if rows := list(packer.finish()):
            yield out(rows)

    return run


def pack_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limits: Limits = DOCUMENTS, added_tokens: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset``.

    ``vocabulary`` is the path of a tokenizer file that every node has.  All tokens of a
    document bear loss.  NULL and empty texts are the end id alone; a text longer than a
    sequence gives whole sequences and one rest; repeated rows and NULL ids are packed like
    any other row; an empty table gives no piece.  Other columns are not read.  With
    ``added_tokens`` the strings of the vocabulary's added tokens give their ids, as they do by
    the tokenizer's default; otherwise they are ordinary text.
    """
    end = END_ID.to_bytes(4, "little")

    def encode(texts: list[str | None]) -> Iterator[tuple[bytes, int]]:
        return ((ids + end, 0) for ids in chunk_ids(vocabulary, added_tokens).encode(texts))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, _pack(["doc_id", "text"], encode, limits), SCHEMA)


def pack_examples(examples: DataFrame, vocabulary: str, *, id_col: str, prompt_col: str, response_col: str, limits: Limits = Limits(loss=2048)) -> DataFrame:
    """Instruction data: only the tokens of the response and the end id bear loss."""
    end = END_ID.to_bytes(4, "little")

    def encode(prompts: list[str | None], responses: list[str | None]) -> Iterator[tuple[bytes, int]]:
        ids = chunk_ids(vocabulary)
        return ((asked + said + end, len(asked) // 4) for asked, said in zip(ids.encode(prompts), ids.encode(responses), strict=True))

    rows = examples.select(F.col(id_col).cast("long").alias("doc_id"), F.col(prompt_col).alias("prompt"), F.col(response_col).alias("response"))
    return map_arrow(rows, _pack(["doc_id", "prompt", "response"], encode, limits), SCHEMA)
