import math
from collections import Counter

import pytest

from convlytics.llm import lm_score


def brute(rows, order, alpha=0.4):
    words = [(t or "").encode().lower().split() for _, t in rows]
    grams = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in words]
    total, size = sum(grams, Counter()), sum(map(len, words))
    out = []
    for (doc, _), own, w in zip(rows, grams, words, strict=True):
        score = 0.0
        for i in range(len(w)):
            back, longest = 0, min(order, i + 1)
            for n in range(longest, 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                seen = total[gram] - own[gram]
                if seen:
                    context = total[gram[:-1]] - own[gram[:-1]] if n > 1 else max(1, size - len(w))
                    score += math.log(seen / context)
                    break
                back += 1
            else:
                score -= math.log(max(1, size - len(w)))
            score += back * math.log(alpha)
        out.append((doc, len(w), score))
    return sorted(out, key=str)


def check(frame, order, **more):
    want = brute([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()], order)
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in lm_score.backoff_scores(frame, order=order, **more).collect()), key=str)
    key = lambda r: (str(r[0]), r[1], round(r[2], 4))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9, abs=1e-6)


@pytest.mark.parametrize(("order", "batch_bytes"), [(1, 1 << 20), (2, 1 << 22), (2, 100), (3, 5000), (5, 1 << 20)])
def test_awkward_rows(awkward, order, batch_bytes):
    check(awkward, order, batch_bytes=batch_bytes)


@pytest.mark.parametrize("order", [2, 3, 5])
def test_real_rows(documents, order):
    check(documents, order)


def test_empty_table_and_a_single_text(nothing, spark):
    assert lm_score.backoff_scores(nothing).collect() == []
    check(spark.createDataFrame([(1, "a b a b c")], "doc_id bigint, text string"), 3)
    row = lm_score.backoff_scores(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).first()
    assert (row.n_words, row.log_score, row.mean_log_score) == (0, 0.0, None)


def test_copies_are_likelier_than_noise(spark):
    rows = [(1, "the cat sat on the mat"), (2, "the cat sat on the mat"), (3, "zq xv kj pw"), (4, "mat the on sat cat the")]
    score = {r.doc_id: r.mean_log_score for r in lm_score.backoff_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert score[1] == score[2] > score[4] > score[3]


def test_the_query_of_order_5_sees_word_order_beyond_three(spark, tmp_path):
    from convlytics.llm.queries import QUERIES

    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, "x b c d y"), (4, "y a b c x c d e")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.log_score for r in QUERIES["op1_lm_score_order5"](spark, str(tmp_path)).collect()}
    assert got == {d: pytest.approx(s, abs=1e-4) for d, _, s in brute(rows, 5)}
    assert got != {d: pytest.approx(s, abs=1e-4) for d, _, s in brute(rows, 3)}


def test_sums_do_not_depend_on_partitions(spark, documents):
    one, many = (sorted((r.doc_id, r.n_words, round(r.log_score, 6)) for r in lm_score.backoff_scores(documents.repartition(n), batch_bytes=b).collect()) for n, b in ((1, 1 << 30), (7, 3000)))
    assert one == many


def test_the_slices_of_the_hashes_hold_every_ngram_once():
    import numpy as np

    rng = np.random.default_rng(3)
    hashes = np.concatenate([rng.integers(0, 2**64, 1000, np.uint64), np.array([0, 2**62, 2**63, 2**64 - 1], np.uint64)])
    for slices in (1, 3, 4):
        edges = lm_score._edges(slices)
        parts = [lm_score._inside(hashes, part, edges) for part in range(slices)]
        assert (sum(p.astype(int) for p in parts) == 1).all() and all(p.sum() > 200 for p in parts)


def test_rows_on_disk_are_those_of_one_slice(spark, monkeypatch):
    """No shuffle holds all n-grams at once, each goes with its write, and the tables between are deleted."""
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 997}" for j in range(300))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    made, gone, old = [], [], (lm_score.released, lm_score.forget)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)

    def released(df, name):
        table, path = old[0](df, name)
        made.append((name, path))
        return table, path

    def forget(session, path):
        gone.append(path)
        old[1](session, path)

    monkeypatch.setattr(lm_score, "released", released)
    monkeypatch.setattr(lm_score, "forget", forget)
    check(frame, 3, batch_bytes=4000)
    assert [name for name, _ in made] == ["shared"] * lm_score.SLICES + ["scores"]
    assert {path for name, path in made if name == "shared"} < set(gone) and len(gone) == lm_score.SLICES + 1
    assert spark.conf.get(key, None) == before


def test_a_slice_is_shuffled_once_and_kept_in_few_rows(spark, monkeypatch):
    """Counts go back to their batch without a second exchange of n-gram rows."""
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(300))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    plans, kept, old = [], [], lm_score.released

    def released(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        table, path = old(df, name)
        kept.append((name, table.count(), df.rdd.getNumPartitions()))
        return table, path

    monkeypatch.setattr(lm_score, "released", released)
    check(frame, 3, batch_bytes=20000)
    shared = [plan for name, plan in plans if name == "shared"]
    assert len(shared) == lm_score.SLICES
    assert all(p.count("Repartition") == 1 and "FlatMapGroups" not in p and "Window" not in p for p in shared)
    assert all(0 < n <= 40 * tasks for name, n, tasks in kept if name == "shared")


def test_numbers_order_and_runs_come_back_whole(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    edges = np.array([0, 1, 127, 128, 2**14 - 1, 2**14, 2**32, 2**63, 2**64 - 1], np.uint64)
    for values in (edges[:0], edges, edges[::-1], rng.integers(0, 3, 500).astype(np.uint64), rng.integers(0, 2**64, 5000, np.uint64)):
        data, sizes = lm_score._numbers(values)
        assert (lm_score._read_numbers(data) == values).all() and sizes.sum() == len(data)
        by, found = lm_score._ordered(values)
        assert (by == np.argsort(values, kind="stable")).all() and (found == np.sort(values)).all()
    monkeypatch.setattr(lm_score, "ROWS_COUNTED", 10)
    keys = np.sort(np.concatenate([rng.integers(-50, 50, 200), np.full(75, 7)]))
    batches = pa.table({"k": keys, "v": np.arange(len(keys))}).to_batches(max_chunksize=8)
    chunks = list(lm_score._whole_runs(iter(batches)))
    assert len(chunks) > 5 and all(a[0][-1] < b[0][0] for a, b in zip(chunks, chunks[1:], strict=False))
    assert (np.concatenate([c[0] for c in chunks]) == keys).all() and (np.concatenate([c[1] for c in chunks]) == np.arange(len(keys))).all()
