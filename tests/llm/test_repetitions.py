"""No single text may end a job: long repetitions through every operator that searches text."""

import pytest
from pyspark.sql import functions as F

from convlytics.llm import exact_dedup, jaccard_join, licences, pii, warc

N = 200_000
NAME, NOTICE = next(iter(licences.TEMPLATES.items()))
SHAPES = ["a.", "a-", "1 ", "4 ", "1.", "1-", "(", "\t", "x@", "@a", "a@b.", "+1", "4111 1111 1111 1111 ", "1/1/"]
TEXTS = [s * N if len(s) < 4 else s * (N // 10) for s in SHAPES] + ["x@" + "a." * N + "com", NOTICE + "\n" + "a-" * N, "\x00" * N]


@pytest.fixture(scope="module")
def repeated(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(4)


def test_pii(repeated):
    rows = {r.doc_id: r for r in pii.pseudonymise(repeated, "key").collect()}
    assert all(len(rows[i].text) == len(t) for i, t in enumerate(TEXTS))
    cards = rows[SHAPES.index("4111 1111 1111 1111 ")].text.split(" ")
    assert "4111" not in cards[0] + cards[1] + cards[2] + cards[3]
    assert rows[len(SHAPES)].n_replaced == 0  # no domain has so many labels


@pytest.mark.parametrize("find", [licences.licence_matches, licences.licence_passages])
def test_licences(repeated, find):
    assert (len(SHAPES) + 1, NAME) in {(r.doc_id, r.licence) for r in find(repeated).collect()}


def test_copies(repeated):
    assert exact_dedup.exact_duplicates(repeated).count() == len(TEXTS)
    assert jaccard_join.similar_texts(repeated, words=4, percent=85).count() == len(TEXTS)


def test_ids_of_any_size(spark):
    ids = [0, -1, 10**13, 2**62, 2**63 - 1, -(2**63), None]
    pages = spark.createDataFrame([(i, "http://a.example/x", "p" * 200) for i in ids] + [(5, "http://b.example/", "q")], "page_id bigint, url string, html string")
    rows = {r.page_id: r for r in warc.archived(pages).collect()}
    assert set(rows) == {*ids, 5}
    assert rows[-(2**63)].record_type == "response" and {rows[i].refers_to for i in ids if i != -(2**63)} == {-(2**63)}
