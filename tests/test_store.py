from frame_values import values
from pyspark.sql import functions as F

from convlytics.operators import store


def blobs(spark, items):
    return spark.createDataFrame([(i, bytearray(b)) for i, b in items], "seq bigint, bytes binary")


def test_put_get_verify(spark):
    first = store.put_blobs(blobs(spark, [(1, b"a"), (2, b"b"), (3, b"a")]))
    assert first.count() == 2
    assert store.put_blobs(blobs(spark, [(4, b"b"), (5, b"c")]), first).count() == 1
    broken = first.withColumn("bytes", F.when(F.col("bytes") == b"b", F.lit(b"x")).otherwise(F.col("bytes")))
    assert store.verify_blobs(first).count() == 0 and store.verify_blobs(broken).count() == 1
    refs = first.select("digest").union(spark.createDataFrame([("0" * 64,), ("zz",)], "digest string"))
    status = sorted(r.status for r in store.get_blobs(refs, broken).collect())
    assert status == ["corrupt", "found", "invalid_digest", "unknown"]


def test_recovery_maps(spark):
    rows = [(2, "fix", "fix thank you"), (1, "fix  ", "please fix"), (3, "other", "other;"), (4, "fix", "please fix")]
    df = spark.createDataFrame(rows, "seq bigint, text string, original string")
    first = store.put_originals(df)
    assert sorted(r.original for r in first.collect()) == ["other;", "please fix"]
    closed = {r.seq: r.rejected for r in store.put_originals(df, "fail_closed").collect()}
    assert closed == {1: False, 2: True, 3: False, 4: False}


def test_recovery_reads_each_text_once(spark):
    """Texts are costly to make: they are made once, and repeated rows meet each copy of the first one."""
    made = spark.sparkContext.accumulator(0)

    def clean(text):
        made.add(1)
        return text.strip()

    rows = [(1, "fix "), (1, "fix "), (2, "fix"), (3, "other"), (4, None)]
    df = spark.createDataFrame(rows, "seq bigint, original string").where("original IS NOT NULL")
    df = df.withColumn("text", F.udf(clean, "string")("original"))
    closed = sorted((r.seq, r.rejected) for r in store.put_originals(df, "fail_closed").collect())
    assert closed == [(1, False)] * 4 + [(2, True)] * 2 + [(3, False)]
    assert made.value == 4


def test_dedup_of_reads(spark):
    rows = [("s", 1, 1, b"x"), ("s", 2, 1, b"x"), ("s", 3, 2, b"x"), ("t", 4, 1, b"x"), ("s", 5, 2, b"served"), ("s", 6, 3, b"served")]
    df = spark.createDataFrame([(s, q, t, bytearray(b)) for s, q, t, b in rows], "session_id string, seq bigint, session_turn bigint, bytes binary")
    served = df.where("seq = 5").select(store.digest(F.col("bytes")).alias("digest"), F.lit(90).cast("bigint").alias("served_at_secs"))
    got = {r.seq: r.referenced for r in store.dedup_repeat_reads(df, served, 100, 300).collect()}
    # The opening request never dedups; recently served bytes stay verbatim.
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False}
    later = {r.seq: r.referenced for r in store.dedup_repeat_reads(df, served, 1000, 300).collect()}
    assert later[6] is True
    text = values(store.dedup_repeat_reads(df, served, 1000, 300, tag="t").where("seq = 6"), "rendered", "seq")[0]
    assert text.startswith("[t:file-ref:") and text.endswith("]\n")


def test_collection_and_retention(spark):
    all_blobs = store.put_blobs(blobs(spark, [(1, b"a"), (2, b"b"), (3, b"c"), (4, b"d")]))
    one = lambda b: store.digest(F.lit(b))
    seen = spark.range(1).select(F.lit("live").alias("session_id"), one(b"a").alias("digest")).union(
        spark.range(1).select(F.lit("dead"), one(b"b"))
    )
    live = spark.createDataFrame([("live",)], "session_id string")
    served = spark.range(1).select(one(b"c").alias("digest"), F.lit(95).alias("served_at_secs")).union(
        spark.range(1).select(one(b"d"), F.lit(101))
    )
    left = store.collectable_blobs(all_blobs, seen, live, served, 100, 10)
    assert sorted(bytes(r.bytes) for r in left.collect()) == [b"b", b"d"]
    log = spark.createDataFrame([("x", 50), ("x", 10), ("x", 200), ("x", None)], "digest string, served_at_secs bigint")
    assert store.retain_served(log, 100, 60).count() == 2


def test_attestations_need_digest_and_place(spark):
    results = blobs(spark, [(0, b"a"), (1, b"b"), (2, b"c")]).withColumnRenamed("seq", "message_index")
    claims = results.select(
        store.digest(F.col("bytes")).alias("digest"),
        F.when(F.col("message_index") == 1, 9).otherwise(F.col("message_index")).alias("message_index"),
        F.lit(True).alias("protected"),
    )
    again = claims.where("message_index = 2")
    got = store.join_attestations(results, claims.union(again), ["message_index"]).collect()
    assert [r.message_index for r in got] == [0]
