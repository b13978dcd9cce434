import hashlib
import random

from convlytics.llm import exact_dedup
from convlytics.llm.exact_dedup import PatriciaTrie


def brute(rows):
    groups = {}
    for doc, text in rows:
        body = (text or "").translate(dict.fromkeys([32, *range(9, 14)]))
        groups.setdefault(body, []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for doc, text in rows:
        body = (text or "").translate(dict.fromkeys([32, *range(9, 14)]))
        keep = min(groups[body])[3]
        out.append((doc, keep, len(groups[body]), doc == keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_awkward_rows_and_spilling(awkward):
    want = brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert found(exact_dedup.exact_duplicates(awkward)) == want
    assert found(exact_dedup.exact_duplicates(awkward, trie_bytes=64)) == want


def test_real_rows(documents):
    assert found(exact_dedup.exact_duplicates(documents)) == brute([tuple(r) for r in documents.collect()])


def test_empty_table(nothing):
    assert exact_dedup.exact_duplicates(nothing).columns[:4] == ["doc_id", "keep_id", "group_size", "kept"]
    assert found(exact_dedup.exact_duplicates(nothing)) == []
    assert exact_dedup.without_copies(nothing).columns == nothing.columns


def test_stage_keeps_rows_and_columns(awkward):
    left = exact_dedup.without_copies(awkward)
    assert left.columns == awkward.columns
    # Case counts, so 1, 2 and 3 differ; both rows of 3 stay; 6 is the longest blank text.
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 3, 6, 7, 9, 10, 11, 12, 13]


def test_trie_holds_what_a_dictionary_holds():
    random.seed(1)
    trie, plain = PatriciaTrie(), {}
    for _ in range(4000):
        key = bytes(random.choice(b"ab") for _ in range(random.randint(0, 12)))
        row = (random.randint(0, 3), random.choice([None, *range(9)]))
        trie.insert(key, *row, 1)
        plain.setdefault(key, []).append(row)
    held = {k: tuple(v) for k, v in trie.drain()}
    assert held == {k: (*min(v, key=lambda x: (-x[0], x[1] is None, x[1] or 0)), len(v)) for k, v in plain.items()}


def test_spilled_subtrees_are_whole():
    trie = PatriciaTrie(most_bytes=1)
    for word in (b"abc", b"abd", b"xyz"):
        trie.insert(word, 1, 1, 1)
    first = {k for k, _ in trie.spill()}
    assert first in ({b"abc", b"abd"}, {b"xyz"})
    assert first | {k for k, _ in trie.drain()} == {b"abc", b"abd", b"xyz"}
