import gzip
import hashlib
import io
import random

import pytest

from convlytics.llm import warc
from convlytics.llm.warc import LoserTree, parse_records, url_key

TRICKY = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 6
ROWS = [
    (7, "http://x.org/a\r\nb", TRICKY),
    (5, "http://x.org/a", TRICKY),
    (9, None, None),
    (10, "", ""),
    (11, "ftp://é.org/ü", "ß" * 50),
    (12, "http://[bad", "ß" * 50),
    (12, "http://[bad", "ß" * 50),
    (13, "u", "ß" * 49 + "x"),
    (14, "u", "ß" * 49 + "x"),
    (None, "http://n.org", "ß" * 50),
    (15, "http://WWW.X.org/A?q=1#frag", "long " * 60_000),
]


def brute(rows):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= warc.LEAST_BYTES and page is not None:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisits = data in first and first[data] != page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisits else "response", first[data] if revisits else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    return frame.withColumns({c: F.lit("x") for c in ("page", "bytes", "digest", "first", "payload", "value", "path", "content", "n")}).repartition(3)


def test_round_trip(pages):
    rows = warc.archived(pages, records=2).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == brute(ROWS)
    assert all(r.intact for r in rows)
    order = [(r.url_key, r.captured) for r in rows]
    assert order == sorted(order) and len({r.archive for r in rows}) >= 4


def test_real_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in table.collect()]
    assert sorted((tuple(r)[:5] for r in warc.archived(table).collect()), key=str) == brute(rows)


def test_empty_table(pages):
    assert warc.archived(pages.limit(0)).collect() == []


def test_files_are_archives(pages, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, records=100)
    records = [r for f in (tmp_path / "w").rglob("*.gz") for r in parse_records(gzip.open(f))]
    assert len(records) == len(ROWS)
    for _, headers, block in records:
        head, _, payload = block.partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200 OK")
        if headers["warc-type"] == "revisit":
            assert payload == b"" and headers["warc-refers-to"]
        else:
            assert headers["warc-payload-digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()


def test_damage_is_seen():
    good = b"WARC/1.1\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [b for _, _, b in parse_records(io.BytesIO(good * 3))] == [b"abcd"] * 3
    with pytest.raises(ValueError, match="cut short"):
        list(parse_records(io.BytesIO(good[:-6])))
    with pytest.raises(ValueError, match="no WARC header"):
        list(parse_records(io.BytesIO(good + b"junk\r\n")))


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges_runs(runs):
    random.seed(runs)
    made = [sorted([(random.choice("abc"), "t", random.choice([None, *range(9)])) for _ in range(random.randint(0, 30))], key=warc._order) for _ in range(runs)]
    merged = list(LoserTree([iter(r) for r in made]))
    assert merged == sorted((c for r in made for c in r), key=warc._order)


def test_url_keys_sort_by_site():
    assert url_key("https://www.Example.org:443/A?b=1#c") == "org,example)/a?b=1"
    assert url_key("http://m.example.org") == "org,example,m)/"
    assert url_key("urn:none") == "urn:none"


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "http://x.org", chr(97 + i % 26) * (50 if i % 5 else 3_000 + 700 * i)) for i in range(60)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write_archives(frame.coalesce(1), f"file://{tmp_path}/w", records=20, archive_bytes=20_000)
    sizes = [[len(b) for _, _, b in parse_records(gzip.open(f))] for f in (tmp_path / "w").rglob("*.gz")]
    assert sum(map(len, sizes)) == 60 and max(map(len, sizes)) == 20
    assert all(len(s) <= 1 or sum(s) <= 20_000 + 300 * len(s) for s in sizes)
    got = sorted((tuple(r)[:5] for r in warc.archived(frame, records=20, archive_bytes=20_000).collect()), key=str)
    assert got == brute(rows)


def test_size_classes_cover_all_sizes():
    classes = warc._size_classes(2_000, 64 << 20)
    assert [held for _, held in classes] == [2000, 250, 31, 3, 1]
    assert all(most * held <= 64 << 20 for most, held in classes[:-1]) and classes[-1][0] >= 1 << 62


@pytest.mark.parametrize(("runs", "block"), [(1, 1), (3, 2), (200, 3), (90, 1000)])
def test_blocks_of_runs_merge_to_one_order(runs, block):
    random.seed(runs)
    whole = []
    for run in range(runs):
        keys = [(random.choice("abcdefgh") * random.randint(1, 3), str(random.randint(0, 9)), random.choice([None, *range(9)])) for _ in range(random.randint(1, 20))]
        whole.append([(*k, f"a{run:03}", i, "response", None, 1, "d", True) for i, k in enumerate(sorted(keys, key=warc._order))])
    blocks = [b.to_pylist()[0] for b in warc._blocks(block)(iter([warc._entries([c for run in whole for c in run])]))]
    blocks.sort(key=lambda b: (b["url_key"], b["captured"], b["given"], b["page_id"]))
    import pyarrow as pa

    merged = [c for b in warc._merged(iter([pa.RecordBatch.from_pylist(blocks, warc._BLOCK_TYPES)])) for c in warc._tuples(b)]
    assert [warc._order(c) for c in merged] == sorted(warc._order(c) for run in whole for c in run)
    assert sorted(merged, key=str) == sorted((c for run in whole for c in run), key=str)


def test_index_of_many_ranges_is_in_order(spark, pages):
    rows = warc.read_captures(spark, _archives(spark, pages)).repartition(4)
    index = warc.ordered_index(rows, per_range=2, per_block=1).collect()
    assert len(index) == len(ROWS) and [warc._order(r) for r in index] == sorted(warc._order(r) for r in index)


def _archives(spark, pages):
    from convlytics.plans.storage import fresh_path

    path = fresh_path(spark, "warc")
    warc.write_archives(pages, path, records=3)
    return path
