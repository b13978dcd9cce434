"""WARC archives of pages, and their index by an external merge.

Writing: records with equal payloads are found by digest.  Digests are counted first, and only the
payloads that may be repeated are shuffled to meet the first of their kind.  That one is a response,
the others are revisit records without a payload.  Pages go by classes of their size, and an
archive of a class holds so many records that its payloads stay within a number of bytes; a larger
page has an archive of its own.

Reading: an archive is parsed by the lengths in its headers and gives a locally sorted run of
captures.  Runs are dealt by ranges of (URL key, time, id), so a host with a third of all pages
spans many ranges, and the number of ranges follows the number of captures.  Spark's external sort
brings the runs of a range in order, cut into blocks, and the blocks in the order of their first
captures; a loser tree merges them and holds only the blocks that overlap.  The ranges in turn are
the globally ordered index.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlytics.llm.common import cut, map_arrow
from convlytics.plans.membership import split_by_filter
from convlytics.plans.storage import fresh_path

#: Payloads under this many bytes are never revisited.
LEAST_BYTES = 100
RECORDS_PER_ARCHIVE = 2_000
ARCHIVE_BYTES = 64 << 20
CAPTURES_PER_RANGE = 250_000
CAPTURES_PER_BLOCK = 1_000
_EPOCH = "2024-01-01 00:00:00"
_YEAR_SECONDS = 366 * 86_400
ENTRY = "url_key string, captured string, page_id long, archive string, place long, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean"
_ENTRY_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_ENTRY = pa.schema([(f.split()[0], _ENTRY_TYPES[f.split()[1]]) for f in ENTRY.split(", ")])


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _size_classes(records: int, archive_bytes: int) -> list[tuple[int, int]]:
    """(largest page in bytes, records per archive) by class: each class holds pages of up to eight times the size."""
    out, most, least = [], records, max(1, archive_bytes // records)
    while most > 1:
        out.append((least, most))
        most, least = max(1, most // 8), least * 8
    return [*out, (1 << 62, 1)]


def write_archives(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", records: int = RECORDS_PER_ARCHIVE, archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """One record per row of ``pages`` in gzipped WARC files below ``path``.

    An archive holds at most ``records`` records and pages of ``archive_bytes``, or one larger page.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long"))
    size = F.col("bytes") + F.coalesce(F.octet_length("url"), F.lit(0))
    classes, smaller = _size_classes(records, archive_bytes), -1
    number = F.lit(len(classes) - 1)
    for i, (most, _) in reversed(list(enumerate(classes[:-1]))):
        number = F.when(size <= most, i).otherwise(number)
    used = {r.number for r in rows.select(number.alias("number")).distinct().collect()}  # at most one row per class
    records_of = _records(rows)
    for i, (most, held) in enumerate(classes):
        if i in used or (not used and i == 0):
            some = records_of.filter((F.col("size") > smaller) & (F.col("size") <= most))
            # The writer ends each value with the line separator: the two line ends behind a record.
            some.select("value").write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", held).text(f"{path}/class={i}")
        smaller = most


def _records(rows: DataFrame) -> DataFrame:
    """``value, size``: the record of each page, and the bytes of page and URL."""
    rows = rows.withColumn("digest", F.sha2(F.encode("payload", "UTF-8"), 256))
    groups = rows.filter(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n"))
    first = groups.filter("n > 1").select("digest", "first")
    maybe, never = split_by_filter(rows, "digest", first)
    rows = maybe.join(first, "digest", "left").unionByName(never.withColumn("first", F.lit(None).cast("long")))
    rows = rows.withColumn("revisits", F.coalesce(F.col("page") > F.col("first"), F.col("first").isNotNull() & F.col("page").isNull()))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    # Pages carry no time of their own: the id gives a second of one year, whatever its size.
    second = F.pmod(F.coalesce("page", F.lit(0)), F.lit(_YEAR_SECONDS))
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(_EPOCH)) + second), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    reference = F.concat(
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", _urn(F.col("first"))),
    )
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisits"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("page"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace("url", "[\\x00-\\x20\\x7f]", ""), F.lit("urn:none"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisits"), reference).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(F.col("revisits"), 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
        http,
        F.when(F.col("revisits"), F.lit("")).otherwise(F.col("payload")),
    )
    return rows.select(record.alias("value"), (F.col("bytes") + F.coalesce(F.octet_length("url"), F.lit(0))).alias("size"))


def url_key(url: str) -> str:
    """Host labels from the right, then path and query, in lower case: a key that sorts by site."""
    try:
        parts = urlsplit(url.strip().lower())
    except ValueError:
        return url.lower()
    host = (parts.hostname or "") if parts.netloc else ""
    if not host:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def parse_records(data: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(number, headers in lower case, block) of each record, by the lengths that headers name."""
    number = 0
    while True:
        line = data.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"record {number}: no WARC header")
        headers = {}
        while (line := data.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = data.read(size)
        if len(block) != size:
            raise ValueError(f"record {number}: cut short")
        yield number, headers, block
        number += 1


def _page(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value not in ("", "none") else None


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives to sorted runs of captures; payload digests are computed again."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            found = []
            for number, headers, block in parse_records(gzip.open(io.BytesIO(content))):
                head, _, payload = block.partition(b"\r\n\r\n")
                named = headers.get("warc-payload-digest", "").removeprefix("sha256:")
                kind = headers["warc-type"]
                if kind == "revisit":
                    size = int(re.search(rb"(?i)\ncontent-length: *(\d+)", head)[1])
                    digest, intact = named, True
                else:
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    intact = digest == named
                found.append((url_key(headers["warc-target-uri"]), headers["warc-date"], _page(headers["warc-record-id"]), path.rsplit("/", 1)[-1], number, kind, _page(headers.get("warc-refers-to")), size, digest, intact))
            found.sort(key=_order)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY)


def _order(capture: tuple) -> tuple:
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next winner takes one
    comparison per level.  Runs may join while it merges."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        self._seed()

    def _seed(self) -> None:
        self.size = len(self.sources)
        self.losers = [-1] * max(1, self.size)
        self.winner = self._play(1) if self.size else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (_order(x), a) < (_order(y), b)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def join(self, sources: list[Iterator[tuple]]) -> None:
        """Let further runs take part: they take the places of ended ones, and the matches are played anew."""
        live = [i for i, head in enumerate(self.heads) if head is not None]
        self.sources = [self.sources[i] for i in live] + sources
        self.heads = [self.heads[i] for i in live] + [next(s, None) for s in sources]
        self._seed()

    def head(self) -> tuple | None:
        return self.heads[self.winner] if self.size else None

    def pop(self) -> tuple:
        first, at = self.heads[self.winner], self.winner
        self.heads[at] = next(self.sources[at], None)
        node = (at + self.size) // 2
        while node:
            if self._beats(self.losers[node], at):
                self.losers[node], at = at, self.losers[node]
            node //= 2
        self.winner = at
        return first

    def __iter__(self) -> Iterator[tuple]:
        while self.head() is not None:
            yield self.pop()


_BLOCK = "url_key string, captured string, given boolean, page_id long, rows binary"
_BLOCK_TYPES = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("given", pa.bool_()), ("page_id", pa.int64()), ("rows", pa.binary())])


def _entries(captures: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*captures, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY)


def _tuples(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple]:
    return zip(*(rows.column(c).to_pylist() for c in _ENTRY.names), strict=True)


def _blocks(most: int):
    """Sorted runs, one after another, to blocks of ``most`` captures under the key of their first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for capture in _tuples(batch):
                if held and (capture[3] != held[0][3] or len(held) == most):
                    yield _block(held)
                    held = []
                held.append(capture)
        if held:
            yield _block(held)

    return run


def _block(held: list[tuple]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ENTRY, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(_entries(held))
    key = (*_order(held[0]), sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(key, _BLOCK_TYPES.types, strict=True)], schema=_BLOCK_TYPES)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in the order of their first captures to one order of all captures.

    Captures leave the tree up to the first key of the blocks that wait.  As many blocks join at a
    time as there are runs in the tree, so the matches that a joining plays anew stay in proportion.
    """
    tree, waiting, out = LoserTree([]), [], []

    def until(key: tuple | None) -> Iterator[pa.RecordBatch]:
        while (head := tree.head()) is not None and (key is None or _order(head) <= key):
            out.append(tree.pop())
            if len(out) == 10_000:
                yield _entries(out)
                out.clear()

    def joined() -> Iterator[pa.RecordBatch]:
        if waiting:
            yield from until(waiting[0][:-1])
            tree.join([_tuples(pa.ipc.open_stream(block[-1]).read_all()) for block in waiting])
            waiting.clear()

    for batch in batches:
        for block in zip(*(batch.column(c).to_pylist() for c in _BLOCK_TYPES.names), strict=True):
            waiting.append(block)
            if len(waiting) >= max(64, tree.size):
                yield from joined()
    yield from joined()
    yield from until(None)
    if out:
        yield _entries(out)


def read_captures(spark, path: str) -> DataFrame:
    """The captures of all archives below ``path``, unordered."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return map_arrow(files.select("path", "content"), _captures, ENTRY)


def ordered_index(captures: DataFrame, *, per_range: int = CAPTURES_PER_RANGE, per_block: int = CAPTURES_PER_BLOCK) -> DataFrame:
    """The captures in ranges of (URL key, time, id), each merged from its runs.  ``captures`` is a written table: it is counted first."""
    fewest = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = captures.repartitionByRange(max(fewest, captures.count() // per_range + 1), "url_key", "captured", "page_id")
    blocks = map_arrow(ranges.sortWithinPartitions("archive", "url_key", "captured", "page_id"), _blocks(per_block), _BLOCK)
    return map_arrow(blocks.sortWithinPartitions("url_key", "captured", "given", "page_id"), _merged, ENTRY)


def archived(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", records: int = RECORDS_PER_ARCHIVE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` to archives, read them back and merge the index of their captures.

    One row per page, in the order of the index: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to, url_key, captured, archive, place, intact``.  A NULL html is an
    empty payload, a NULL url has the key of ``urn:none``.  Of equal payloads of at least 100
    bytes the smallest id is the response; a NULL id revisits it, and repeated rows (same id)
    are all responses if that id is the smallest.  Payloads may hold anything, line ends and
    WARC headers too; an empty table writes no record and gives no row.
    """
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col=id_col, url_col=url_col, html_col=html_col, records=records, archive_bytes=archive_bytes)
    index = ordered_index(cut(read_captures(pages.sparkSession, path), "captures"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "archive", "place", "intact")
