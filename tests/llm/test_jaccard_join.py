import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from convlytics.llm import jaccard_join
from convlytics.llm.components import components
from convlytics.llm.shingles import shingle_sets


def brute(rows, words, percent):
    def grams(text):
        w = (text or "").encode().lower().split()
        if len(w) < words:
            return frozenset([tuple(w)] if w else [])
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1))

    sets = {d: grams(t) for d, t in rows if d is not None}
    up = {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    for d, s in sets.items():
        for other, shared in Counter(o for g in s for o in holders[g] if o < d).items():
            if 100 * shared >= percent * (len(s) + len(sets[other]) - shared):
                a, b = find(d), find(other)
                up[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check(frame, words, percent, **more):
    want = brute([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()], words, percent)
    got = jaccard_join.similar_texts(frame, words=words, percent=percent, **more).collect()
    assert len(got) == frame.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_awkward_rows(awkward):
    check(awkward, 4, 85)


def test_real_rows(documents):
    check(documents, 5, 80)


@pytest.mark.parametrize(("words", "percent", "frequent"), [(4, 85, 64), (2, 75, 2), (5, 80, 3)])
def test_large_groups_of_near_copies(spark, monkeypatch, words, percent, frequent):
    """One base text with edits, blocks far smaller than the group, and most tokens frequent."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    random.seed(percent)
    base = [f"b{random.randint(0, 400)}" for _ in range(90)]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(220):
        text = list(base) if i % 2 else [f"r{random.randint(0, 900)}" for _ in range(30)] + passage
        for _ in range(random.choice([0, 1, 1, 2, 3, 5])):
            text[random.randrange(len(text))] = random.choice([f"e{random.randint(0, 5)}", f"u{random.random()}"])
        if random.random() < 0.3:
            del text[random.randrange(len(text)) :][:4]
        rows.append((i * 7 % 220, " ".join(text)))
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), words, percent, frequent=frequent)


def test_empty_table(nothing):
    assert jaccard_join.similar_texts(nothing).collect() == []
    assert jaccard_join.one_of_each(nothing).columns == nothing.columns


def test_stage_keeps_one_of_each(awkward):
    left = jaccard_join.one_of_each(awkward, words=4, percent=85)
    assert left.columns == awkward.columns
    ids = [r.doc_id for r in left.collect() if r.doc_id is not None]
    assert sorted(ids) == [1, 4, 5, 6, 7, 9, 11, 12, 13]


def test_thresholds_without_a_proof_are_refused(awkward):
    with pytest.raises(ValueError, match="75"):
        jaccard_join.similar_texts(awkward, percent=40)


def test_prefixes_share_an_entry_whatever_the_classes():
    """Any two similar sets have a signature in common, for random orders and frequencies."""
    random.seed(4)
    for _ in range(300):
        percent = random.choice([75, 80, 85, 90])
        n = random.randint(6, 150)
        a = set(range(n))
        b = set(a)
        for _ in range(random.randint(0, n // 8)):
            b.discard(random.randrange(n))
            if random.random() < 0.5:
                b.add(1000 + random.randrange(50))
        if 100 * len(a & b) < percent * len(a | b):
            continue
        df = {t: random.choice([2, 3, 100, 100, 500]) for t in a | b}
        sigs = [set(jaccard_join._signatures(len(s), 0, sorted((0, df[t], t * 2654435761 % (1 << 61)) for t in s), percent)) for s in (a, b)]
        assert sigs[0] & sigs[1], (percent, n)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (50, 50), (100, 101), (200, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 200: 1, 100: 100, 101: 100, 102: 100}


def test_shingles_of_batches_equal_those_of_single_texts():
    texts = ["a b c d e", None, "", "x", "A  B\tc d e f", "\x0ba\x0cb", "é 日本 é 日本 é", "d e"]
    together = list(shingle_sets(pa.array(texts), 3))
    for text, some in zip(texts, together, strict=True):
        assert np.array_equal(next(iter(shingle_sets(pa.array([text], pa.string()), 3))), some)
    assert [len(s) for s in together] == [3, 0, 0, 1, 4, 1, 2, 1]
