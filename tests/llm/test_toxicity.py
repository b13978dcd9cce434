import zlib

import pytest
from pyspark.sql import functions as F

from convlytics.llm import toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    return docs, labels, model


def test_held_out_accuracy(scored):
    docs, labels, model = scored
    rows = model.score(docs).join(labels, "doc_id").withColumn("held", toxicity.fold_of(F.col("doc_id")) == 0).filter("held").collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in rows)
    assert right >= 0.95 * len(rows)
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.score >= 0.5 for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_the_held_out_fold_are_not_read(scored, spark):
    docs, labels, model = scored
    held = toxicity.fold_of(F.col("doc_id")) == 0
    other = toxicity.fit(docs, labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    a, b = (sorted((r.doc_id, r.score) for r in m.score(docs).collect()) for m in (model, other))
    assert a == b


def test_folds_follow_the_checksum(spark):
    ids = [0, 1, 7, 12345, None]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select("doc_id", toxicity.fold_of(F.col("doc_id")).alias("f"))
    assert {r.doc_id: r.f for r in frame.collect()} == {i: None if i is None else zlib.crc32(str(i).encode()) % 5 for i in ids}


def test_awkward_rows(scored, awkward):
    model = scored[2]
    rows = model.score(awkward, score_col="score").collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert len({r.score for r in rows if r.text == "one"}) == 1


def test_queries_of_awkward_and_empty_tables(awkward, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 7), (99, 1)], "doc_id bigint, toxic int")
    rows = toxicity.toxic_scores(awkward, labels).collect()
    assert len(rows) == awkward.count()
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.toxic_scores(nothing, labels).collect() == []
    assert toxicity.toxic_scores(awkward, labels.limit(0)).filter("score <> 0").count() == 0
    assert toxicity.without_toxic(awkward, labels).columns == awkward.columns


def test_features_see_hidden_and_addressed_insults():
    chunks = toxicity._Chunks({"idiot": 3.0})
    names = toxicity.FEATURES
    plain, hidden, near = (dict(zip(names, toxicity.features_of(t, chunks), strict=True)) for t in ("the IDIOT, there", "the 1d10t there", "you idiot"))
    assert plain["lexicon_hits"] > 0 and plain["insult_density"] == 1 / 3 and plain["capitals"] > 0
    assert hidden["obfuscated_hits"] == 1 / 3 and hidden["lexicon_hits"] > 0
    assert near["near_second_person"] == 1 / 2 and plain["near_second_person"] == 0
    assert toxicity.features_of(None, chunks) == toxicity.features_of("", chunks) == [0.0] * len(names)


def test_stage_drops_toxic_and_keeps_clean(scored):
    docs, labels, model = scored
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).select("doc_id").collect()}
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(known.get(d) == 0 for d in kept) == sum(t == 0 for t in known.values())
    assert sum(known.get(d) == 1 for d in kept) <= 0.4 * sum(t == 1 for t in known.values())
