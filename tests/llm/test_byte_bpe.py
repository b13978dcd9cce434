import array
import base64
import codecs
import gc
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from convlytics.llm import byte_bpe
from convlytics.llm.byte_bpe import Codec, StreamDecoder, Transducer

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return Codec(PATH, PATTERN)


def packed(ids):
    return array.array("I", ids).tobytes()


def test_random_texts(own, plain):
    random.seed(3)
    letters = "ab é́ß日本\U0001f600\x1c\x85\xa0   \n\t'sS12٣½ªº_-#"
    for _ in range(2500):
        text = "".join(random.choices(letters, k=random.randint(0, 40)))
        ids = own.encode(text)
        assert ids == packed(plain.encode_ordinary(text)), text
        assert own.decode(ids) == text


def test_long_words_and_few_states(ranks, plain):
    random.seed(4)
    small = Transducer(ranks, most_states=40)
    for _ in range(300):
        word = "".join(random.choices("aehinorst", k=random.randint(1, 300)))
        assert small.encode(word.encode()) == plain.encode_ordinary(word)
    assert len(small.states) <= 41


def test_lookahead_is_bounded(ranks):
    """Tokens leave while the text goes on: what is held back stays under the longest token."""
    transducer = Transducer(ranks)
    longest = max(map(len, ranks))
    state = transducer.start
    for byte in b"internationalizationofeverythingunderthesun" * 40:
        state, _ = state.next.get(byte) or transducer.step(state, byte)
        assert len(state.suffix) <= longest
    assert len(state.end) <= longest


def test_bytes_that_are_no_text(ranks, plain):
    random.seed(6)
    transducer = Transducer(ranks)
    for _ in range(400):
        data = bytes(random.choices([0, 65, 97, 0xC3, 0xA9, 0xFF, 0xE2, 0x82], k=random.randint(1, 24)))
        assert transducer.encode(data) == plain._encode_single_piece(data)


def test_streaming_decoder_equals_the_standard_one(ranks):
    random.seed(7)
    decoder = StreamDecoder({r: b for b, r in ranks.items()})
    tokens = [ranks[bytes([b])] for b in range(256)]
    for _ in range(500):
        ids = random.choices([*tokens[0x60:0x70], *tokens[0x80:]], k=random.randint(0, 20))
        standard = codecs.getincrementaldecoder("utf-8")("replace")
        data = b"".join(decoder.bytes_of[i] for i in ids)
        assert decoder.feed(ids) + decoder.finish() == standard.decode(data, True)


def test_awkward_rows(awkward, plain):
    want = []
    for r in awkward.collect():
        ids = plain.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in byte_bpe.round_trips(awkward, PATH, PATTERN).collect()), key=str) == sorted(want, key=str)
    encoded = byte_bpe.encode_texts(awkward, PATH, PATTERN)
    texts = sorted(((r.doc_id, r.text) for r in byte_bpe.decode_ids(encoded, PATH, PATTERN).collect()), key=str)
    assert texts == sorted(((r.doc_id, r.text or "") for r in awkward.collect()), key=str)


def test_real_rows(documents, plain):
    got = {r.doc_id: r.ids_sha256 for r in byte_bpe.round_trips(documents, PATH, PATTERN).collect()}
    assert got == {r.doc_id: hashlib.sha256(packed(plain.encode_ordinary(r.text))).hexdigest() for r in documents.collect()}


def test_empty_table(nothing):
    assert byte_bpe.round_trips(nothing, PATH, PATTERN).collect() == []


def test_pieces_that_come_again_stay(plain, monkeypatch):
    codec, made = Codec(PATH, PATTERN), []
    encode = codec.transducer.encode
    monkeypatch.setattr(byte_bpe, "MOST_PIECES", 10)
    monkeypatch.setattr(codec.transducer, "encode", lambda piece: made.append(piece) or encode(piece))
    for i in range(40):
        text = " the " + "ab" * (i + 1)
        assert codec.encode(text) == packed(plain.encode_ordinary(text))
    assert made.count(b" the") == 1 and len(codec) + len(codec.old) <= 10


def test_a_full_table_leaves_no_cycles(ranks):
    random.seed(8)
    small = Transducer(ranks, most_states=40)
    gc.collect()
    gc.disable()
    try:
        for _ in range(200):
            small.encode("".join(random.choices("aehinorst", k=50)).encode())
        assert gc.collect() < 40
    finally:
        gc.enable()
