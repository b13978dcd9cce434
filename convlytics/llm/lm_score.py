"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

The plan is relational.  Documents are tokenised into batches of bounded size, one row each.  The
range of n-gram hashes is cut into a fixed number of equal slices, counted one after the other, so
that the rows of one slice only are on disk at a time.  In a slice, a batch explodes to its distinct
n-grams, rows of (hash, batch, rank within the batch and slice with occurrences), which are partitioned
and sorted by hash; each row gets the sum of the other batches over its run of equal hashes.  Where
there is any it goes back to its batch: a task keeps what it found for one batch in one row, never more
rows than n-grams found.  Batch and sums meet in a cogroup, where every document is scored as the sum
over its words.

A frequent n-gram is one row per batch, however often it occurs, so no key is hot.  Rows grow in
proportion to the corpus, a task streams or sorts them, and the only groups held are batches and runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlytics.llm.common import forget, in_pieces, map_arrow, release_free, released, written
from convlytics.llm.shingles import forget_powers, longer_hashes, word_hashes
from convlytics.plans.once import attach_row
from convlytics.plans.packaging import ship_package

ALPHA = 0.4
ORDER = 3
BATCH_BYTES = 8 << 20
ROWS_SENT = 1 << 16
#: Rows of a task that are counted at once, and counts that wait to be packed by batch.
ROWS_COUNTED = 1 << 18
ROWS_PACKED = 1 << 21
#: Slices of the hashes for n-grams of up to ``ORDER`` words, in proportion for others.
SLICES = 4
_BATCH = "batch long, head binary, known binary, places binary"
_BATCH_TYPES = pa.schema([("batch", pa.int64()), *((c, pa.binary()) for c in ("head", "known", "places"))])
_GRAM = "hash long, batch long, rank_n long"
_PACKED = "batch long, slice int, size int, packed binary"
_PART = "doc_id long, n_words long, part double, divided long"


def _grams(words: np.ndarray, doc: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n up to ``order``: hashes of the n-grams within a document, and the places they end at."""
    out, runs = [], np.zeros(len(words), np.uint64)
    for n in range(1, order + 1):
        if len(words) < n:
            out.append((words[:0], np.zeros(0, np.int64)))
            continue
        runs = longer_hashes(runs, words[n - 1 :])
        whole = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
        out.append((runs[whole], whole + n - 1))
    return out


def _ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable argsort of unsigned numbers, and the sorted numbers.

    Plain sorting is several times faster than numpy's argsort, so the upper bits are sorted with the
    places below them; where numbers differ in the lower bits only, the nearly sorted rest is mended.
    """
    low = np.uint64((1 << len(values).bit_length()) - 1)
    by = values & ~low
    by |= np.arange(len(values), dtype=np.uint64)
    by.sort()
    by &= low
    by = by.view(np.int64)
    found = values[by]
    if (found[1:] < found[:-1]).any():
        mend = np.argsort(found, kind="stable")
        by, found = by[mend], found[mend]
    return by, found


def _begins(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])[: len(sorted_values)]


def _numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers in as few bytes of seven bits as each needs, and how many bytes each takes."""
    sizes, rest = np.ones(len(values), np.int64), values >> np.uint64(7)
    while rest.any():
        sizes += rest > 0
        rest >>= np.uint64(7)
    out, at, rest = np.empty(sizes.sum(), np.uint8), np.cumsum(sizes) - sizes, values
    while len(rest):
        more = rest > 127
        out[at] = (rest & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        at, rest = at[more] + 1, rest[more] >> np.uint64(7)
    return out, sizes


def _read_numbers(data: np.ndarray) -> np.ndarray:
    """The numbers that `_numbers` wrote."""
    ends = np.flatnonzero(data < 128)
    at = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    values, which, shift = np.zeros(len(ends), np.uint64), np.arange(len(ends)), 0
    while len(which):
        values[which] |= (data[at] & 127).astype(np.uint64) << np.uint64(shift)
        more = data[at] > 127
        at, which, shift = at[more] + 1, which[more], shift + 7
    return values


def _batches(batch_bytes: int):
    """Rows of documents to rows of batches: ids and sizes, known words, and the word at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for piece in in_pieces(batches, "text", batch_bytes):
            words, counts = word_hashes(piece.column("text"))
            by, found = _ordered(words)
            begins = _begins(found)
            known = found[begins]
            times = np.diff(np.flatnonzero(begins), append=len(found))
            often = np.argsort(-times, kind="stable")  # frequent words have small numbers
            number_of = np.empty(len(known), np.uint32)
            number_of[often] = np.arange(len(known), dtype=np.uint32)
            places = np.empty(len(words), np.uint32)
            places[by] = np.repeat(number_of, times)
            planes = np.ascontiguousarray(places.view(np.uint8).reshape(-1, 4).T)
            ids = piece.column("doc_id")
            head = np.concatenate([np.array(ids.fill_null(0), np.int64), np.array(ids.is_null(), np.int64), counts.astype(np.int64)])
            row = [number, zlib.compress(head.tobytes(), 1), known[often].tobytes(), pa.compress(planes.tobytes(), "zstd", asbytes=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(_BATCH_TYPES.names, row, strict=True))], _BATCH_TYPES)
            number += 1
        forget_powers()

    return run


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, flags of NULL ids and sizes), the words in order, and the document of each."""
    head = np.frombuffer(zlib.decompress(row["head"]), np.int64).reshape(3, -1)
    known = np.frombuffer(row["known"], np.uint64)
    planes = np.frombuffer(pa.decompress(row["places"], int(head[2].sum()) * 4, "zstd", asbytes=True), np.uint8)
    places = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
    return head, known[places], np.repeat(np.arange(head.shape[1], dtype=np.int32), head[2])


def _edges(slices: int) -> np.ndarray:
    """Where each slice of the hashes but the first begins."""
    return np.array([(i << 64) // slices for i in range(1, slices)], np.uint64)


def _exploded(order: int, part: int, slices: int):
    """The distinct n-grams of each batch whose hashes lie in a slice, in rows."""
    edges = _edges(slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                _, words, doc = _opened(row)
                some = [h[_inside(h, part, edges)] for h, _ in _grams(words, doc, order)]
                grams, times = np.unique(np.concatenate(some), return_counts=True)
                for start in range(0, len(grams), ROWS_SENT):
                    hashes = grams[start : start + ROWS_SENT].view(np.int64)
                    rank_n = np.arange(start, start + len(hashes)) << 32 | times[start : start + ROWS_SENT]
                    columns = [hashes, np.full(len(hashes), row["batch"]), rank_n]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "batch", "rank_n"])

    return run


def _inside(hashes: np.ndarray, part: int, edges: np.ndarray) -> np.ndarray:
    inside = np.ones(len(hashes), bool)
    if part:
        inside &= hashes >= edges[part - 1]
    if part < len(edges):
        inside &= hashes < edges[part]
    return inside


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of a partition sorted by its first, many rows at a time, no run of equal values cut."""
    held, size, most = [], 0, ROWS_COUNTED
    for batch in batches:
        held.append([np.asarray(c) for c in batch.columns])
        size += batch.num_rows
        if size < most:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        end = int(np.searchsorted(columns[0], columns[0][-1]))
        if end:
            yield [c[:end] for c in columns]
        held, size = [[c[end:].copy() for c in columns]], size - end
        most = max(ROWS_COUNTED, 2 * size)
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _counted(part: int):
    """Rows of n-grams sorted by hash to what other batches hold of them, one row per batch at a time."""

    def packed(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        batch, rank, others = (np.concatenate(c) for c in zip(*found, strict=True))
        known = np.unique(batch)
        at = np.searchsorted(known, batch)
        place = (at * (rank.max() + 1) + rank).astype(np.uint64)
        by, _ = _ordered(place << np.uint64(64 - int(place.max()).bit_length()) if place.any() else place)
        sizes = np.bincount(at, minlength=len(known))
        starts = np.cumsum(sizes) - sizes
        rank = rank[by]
        steps = np.diff(rank, prepend=0)
        steps[starts] = rank[starts]
        data, widths = _numbers(np.stack([steps, others[by]], 1).ravel().astype(np.uint64))
        edges = np.concatenate([[0], np.cumsum(np.add.reduceat(widths, 2 * starts))]).astype(np.int32)
        values = pa.Array.from_buffers(pa.binary(), len(known), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        columns = [pa.array(known), pa.array(np.full(len(known), part, np.int32)), pa.array(sizes.astype(np.int32)), values]
        return pa.RecordBatch.from_arrays(columns, names=["batch", "slice", "size", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for hashes, batch, rank_n in _whole_runs(batches):
            starts = np.flatnonzero(_begins(hashes))
            n = rank_n & 0xFFFFFFFF
            others = np.repeat(np.add.reduceat(n, starts), np.diff(starts, append=len(hashes))) - n
            some = np.flatnonzero(others)
            if len(some):
                found.append((batch[some], rank_n[some] >> 32, others[some]))
                size += len(some)
            if size >= ROWS_PACKED:
                yield packed(found)
                found, size = [], 0
        if found:
            yield packed(found)

    return run


def _unpacked(packed: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of n-grams among those of their batch, given where each slice begins, and what others hold."""
    sizes = np.asarray(packed.column("size"), np.int64)
    values = _read_numbers(np.frombuffer(b"".join(packed.column("packed").to_pylist()), np.uint8)).astype(np.int64)
    steps, others = values[::2], values[1::2]
    places, starts = np.cumsum(steps), np.cumsum(sizes) - sizes
    return places + np.repeat(first[np.asarray(packed.column("slice"))] - (places[starts] - steps[starts]), sizes), others


def _scored(order: int, alpha: float, slices: int):
    """A batch and what others hold of its n-grams to one row per document."""
    edges = _edges(slices)

    def run(batch: pa.Table, packed: pa.Table) -> pa.Table:
        head, words, doc = _opened(batch.to_pylist()[0])
        grams = _grams(words, doc, order)
        hashes, grams = np.concatenate([g for g, _ in grams]), [ends for _, ends in grams]
        by, hashes = _ordered(hashes)  # equal n-grams stay in the order of their documents
        owner = np.concatenate([doc[ends] for ends in grams])[by]
        begins = _begins(hashes)
        starts = np.flatnonzero(begins)
        totals = np.diff(starts, append=len(hashes))
        first = np.concatenate([[0], np.searchsorted(hashes[starts], edges)])
        if packed.num_rows:
            places, others = _unpacked(packed, first)
            totals[places] += others
            del places, others
        begins[1:] |= owner[1:] != owner[:-1]
        times = np.diff(np.flatnonzero(begins), append=len(hashes))
        elsewhere = np.empty(len(hashes), np.int64)
        elsewhere[by] = np.repeat(totals, np.diff(starts, append=len(hashes))) - np.repeat(times, times)
        del hashes, owner, by, begins, starts, totals, times
        seen = np.zeros((order + 1, len(words)))  # occurrences in other documents of the n-gram that ends here
        at = 0
        for n, ends in enumerate(grams, 1):
            seen[n, ends] = elsewhere[at : at + len(ends)]
            at += len(ends)
        del elsewhere, grams
        longest = np.minimum(order, _places(head[2]))  # of the n-grams that end here and start in the document
        log_share, backed = np.full(len(words), np.nan), np.log(alpha)
        for n in range(order, 1, -1):
            before = np.concatenate([[0.0], seen[n - 1, :-1]])
            best = np.isnan(log_share) & (seen[n] > 0)
            log_share[best] = np.log(seen[n, best] / before[best]) + (longest[best] - n) * backed
        rest = np.isnan(log_share)
        # The size of the corpus is not known here: the last division is by all other words.
        log_share[rest] = np.log(np.maximum(seen[1, rest], 1)) + (longest[rest] - 1 + (seen[1, rest] == 0)) * backed
        docs = head.shape[1]
        del seen
        release_free()
        return pa.table(
            {
                "doc_id": pa.array(head[0], pa.int64(), mask=head[1] == 1),
                "n_words": pa.array(head[2], pa.int64()),
                "part": pa.array(np.bincount(doc, log_share, docs), pa.float64()),
                "divided": pa.array(np.bincount(doc, rest, docs).astype(np.int64), pa.int64()),
            }
        )

    return run


def _places(counts: np.ndarray) -> np.ndarray:
    """1, 2, 3, ... within each document."""
    ends = np.cumsum(counts)
    return np.arange(1, (ends[-1] if len(ends) else 0) + 1) - np.repeat(ends - counts, counts)


def backoff_scores(docs: DataFrame, *, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_words, log_score, mean_log_score``.

    Words are runs of anything but blanks, A-Z in lower case.  Each word is scored by the
    longest n-gram (up to ``order``, within the document) that *other* documents hold: its count
    over that of its context, times ``alpha`` for each step back; a word that no other document
    holds counts as once, after one more step.  Shares of single words are of all words of the
    other documents.  Counts cover all documents and leave out the scored document's own, so
    copies in other rows count and a text alone scores by chance alone.

    NULL and empty texts score 0 with a mean of NULL; repeated rows count as different
    documents; NULL ids are kept; an empty table gives no row; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    batches, path = written(map_arrow(rows, _batches(batch_bytes), _BATCH), "batches")
    slices, tables, paths = -(-SLICES * order // ORDER), [], [path]
    for part in range(slices):
        # The count table beside its n-grams: a run of one hash has one row per batch at most.
        grams = map_arrow(batches, _exploded(order, part, slices), _GRAM).repartition("hash").sortWithinPartitions("hash")
        packed, path = released(map_arrow(grams, _counted(part), _PACKED), "shared")
        tables.append(packed)
        paths.append(path)
    shared = reduce(DataFrame.unionAll, tables)
    parts, _ = released(batches.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(_scored(order, alpha, slices), _PART), "scores")
    for path in paths:
        forget(spark, path)
    full = attach_row(parts, parts.agg(F.sum("n_words").alias("__all")))
    others = F.greatest(F.col("__all") - F.col("n_words"), F.lit(1))
    scored = full.select("doc_id", "n_words", (F.col("part") - F.when(F.col("divided") > 0, F.col("divided") * F.log(others)).otherwise(0.0)).alias("log_score"))
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
