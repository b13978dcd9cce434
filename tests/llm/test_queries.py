"""Every corpus query against its SQL, or for its columns, on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, normal
from convlytics.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op4_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op5_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op6_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op8_kd_search": {"query_id", "rank", "vec_id", "score"},
    "op9_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op11_merkle": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    "op12_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op13_centroids": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
    "op10_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
}


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n in QUERIES if n.startswith("op")] == sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, SF)
    assert COLUMNS.get(name, set()) <= set(frame.columns)
    rows = frame.collect()
    assert rows
    if name in ORACLES:
        db = duckdb.connect()
        for table in TABLES:
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        cursor = db.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(frame.columns)
        want = sorted(str([normal(v) for v in r]) for r in cursor.fetchall())
        assert sorted(str([normal(r[c]) for c in names]) for r in rows) == want
