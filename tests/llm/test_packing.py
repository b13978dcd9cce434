import array
import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from convlytics.llm import packing
from convlytics.llm.packing import Limits, VectorPacker
from convlytics.llm.word_bpe import ChunkIds

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def whole(frame, limits):
    """Pieces cover each document once, sequences have no gap and no limit is passed."""
    rows = [r.asDict() for r in frame.collect()]
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(some) <= limits.segments
        assert sum(r["loss_tokens"] for r in some) <= limits.loss
    return rows, by_sequence


def test_awkward_rows(awkward, tokenizer):
    limits = packing.DOCUMENTS
    rows, _ = whole(packing.pack_documents(awkward, PATH), limits)
    want, got = [], {}
    for r in awkward.collect():
        ids = array.array("I", [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID]).tobytes()
        want.append((r.doc_id, ids))
    for r in rows:
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    for doc, ids in want:
        pieces = sorted(got[doc, len(ids) // 4])
        copies = sum(x == (doc, ids) or (x[0] == doc and len(x[1]) == len(ids)) for x in want)
        assert sum(length for _, length, _ in pieces) == copies * len(ids) // 4
        if copies == 1:
            at = 0
            for start, length, crc in pieces:
                assert start == at and crc == zlib.crc32(ids[4 * start : 4 * (start + length)])
                at += length


def test_little_padding(documents):
    rows, by_sequence = whole(packing.pack_documents(documents.coalesce(1), PATH), packing.DOCUMENTS)
    assert {r["doc_id"] for r in rows} == {r.doc_id for r in documents.collect()}
    assert sum(4096 - sum(r["length"] for r in s) for s in by_sequence.values()) <= 4096 + 16 * len(by_sequence)


def test_empty_table(nothing):
    assert packing.pack_documents(nothing, PATH).collect() == []


def test_limits_hold_together(spark):
    random.seed(2)
    rows = [(i, "ask " * random.choice([0, 3, 40, 300]), random.choice([None, "", "say " * random.choice([1, 20, 200, 700])])) for i in range(150)]
    frame = spark.createDataFrame(rows, "id bigint, q string, a string")
    limits = Limits(tokens=256, segments=6, loss=100, least=4, pool=32)
    packed, _ = whole(packing.pack_examples(frame, PATH, id_col="id", prompt_col="q", response_col="a", limits=limits), limits)
    for i, q, a in rows:
        own = sorted((r["start"], r["length"], r["loss_tokens"]) for r in packed if r["doc_id"] == i)
        n, bears = len(q.split()) + len((a or "").split()) + 1, len((a or "").split()) + 1
        assert sum(x[1] for x in own) == n and sum(x[2] for x in own) == bears
        assert all(x[0] + x[1] == y[0] for x, y in zip(own, own[1:], strict=False))


def test_dot_product_prefers_what_is_left():
    """With few segments left open, long pieces go first; small ones fill the rest."""
    packer = VectorPacker(Limits(tokens=100, segments=3, loss=100, least=5), 0)
    for i, n in enumerate([10, 60, 30, 10]):
        assert list(packer.add(i, bytes(4 * n), 0)) == []
    rows = list(packer.finish())
    assert [r[0] for r in rows if r[6] == 0] == [1, 2, 0]


def test_ids_equal_the_tokenizer(tokenizer):
    random.seed(5)
    ids = ChunkIds(PATH)
    letters = [*"abcéßÇ日́İΣσςǆªº '\"#$.-/12٣\t\n\r\x1c\x85\xa0 <=≯", "<|endoftext|>", "'s", "'T", "don't", "hello", "WORLD..."]
    texts = ["".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(1500)]
    want = [array.array("I", e.ids).tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.encode(texts) == want


def test_forgetting_changes_nothing(documents, monkeypatch):
    texts = [r.text for r in documents.limit(20).collect()]
    want = ChunkIds(PATH).encode(texts)
    monkeypatch.setattr("convlytics.llm.word_bpe.MOST_BYTES", 10_000)
    small = ChunkIds(PATH)
    assert [small.encode([t])[0] for t in texts] == want


def test_the_query_takes_added_tokens_as_the_plain_call_does(spark, tmp_path):
    from convlytics.llm.queries import QUERIES

    plain = Tokenizer.from_file(PATH)
    random.seed(6)
    letters = [*"abÇ日 İΣ '.-/1\t\n\r\x85\xa0 <|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "hi", "don't"]
    texts = ["hi <|endoftext|> you", *("".join(random.choices(letters, k=random.randint(0, 15))) for _ in range(1500))]
    want = [array.array("I", plain.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert ChunkIds(PATH, added_tokens=True).encode(texts) == want
    spark.createDataFrame(list(enumerate(texts[:20])), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.doc_tokens for r in QUERIES["op9_packing"](spark, str(tmp_path)).collect()}
    assert got == {i: len(ids) // 4 + 1 for i, ids in enumerate(want[:20])}


@pytest.mark.parametrize(("least", "most"), [(2, 20), (1, 2), (1, 9000)])
def test_short_and_mixed_pieces_fill_sequences(least, most):
    dice = random.Random(least + most)
    packer, rows, total = VectorPacker(packing.DOCUMENTS, 0), [], 0
    for doc in range(20_000 if most < 100 else 400):
        n = dice.randrange(least, most + 1)
        total += n
        rows.extend(packer.add(doc, array.array("I", range(n)).tobytes(), 0))
        assert len(packer.items) <= 2 * 4096
    rows.extend(packer.finish())
    assert sum(r[2] for r in rows) == total
    assert len({r[6] for r in rows}) <= total / 4096 / 0.99 + 1
