import random

from pyspark.sql import functions as F

from convlytics.operators import sessions, usage
from convlytics.streaming import admission, stitching, windows
from convlytics.streaming.sink import run_available, stateful_session, write_batches


def arriving(session, folder, parts):
    """A stream that gets each frame as a micro-batch of its own."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return session.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stitching_in_any_order_equals_batch(spark, tmp_path):
    dice = random.Random(4)
    rows = []
    for n in range(300):
        first = dice.choice(["hello", "hello", "hello", "fix it", f"m{dice.randrange(4)}", None])
        rows.append((f"r{n}", n, 1_700_000_000 + n * dice.choice([0, 1]) * 400 // 3 + n * 200, first))
    rows = [(i, n, at, m) for n, (i, _, at, m) in enumerate(sorted(rows, key=lambda r: (r[2], r[1])))]
    whole = spark.createDataFrame(rows, "request_id string, seq bigint, at_secs bigint, first_message string")
    want = {(r.request_id, r.session_id, r.opened) for r in sessions.stitch_sessions(whole, ttl=900).collect()}

    session = stateful_session(spark)
    mixed = rows[:]
    dice.shuffle(mixed)
    ends = [[("end0", -1, 1_800_000_000, None)], [("end1", -1, 1_900_000_000, None)]]
    frames = [
        session.createDataFrame(some, "request_id string, seq bigint, at_secs bigint, first_message string").withColumn("event_time", F.timestamp_seconds("at_secs"))
        for some in (mixed[:100], mixed[100:200], mixed[200:], *ends)
    ]
    stream = arriving(session, str(tmp_path / "in"), frames)
    out = spark.read.parquet(run_available(stitching.stitch_stream(stream, ttl=900, delay="10 days"), "stitch"))
    got = {(r.request_id, r.session_id, r.opened) for r in out.where("request_id NOT LIKE 'end%'").collect()}
    assert got == want and len({s for _, s, _ in want}) > 20


def test_late_and_future_rows_go_to_the_side(spark, tmp_path):
    parts = [[(1, 100), (2, 200), (3, None), (4, 5000)], [(5, 150), (6, 90), (7, 300)], [(8, 199), (9, 249), (10, 250), (11, 901)]]
    frames = [spark.createDataFrame(p, "id bigint, secs bigint") for p in parts]
    edge = admission.Admission(spark, str(tmp_path / "state"), F.col("secs"), delay_secs=50, clock=lambda: 900)
    out = spark.read.parquet(run_available(arriving(spark, str(tmp_path / "in"), frames), "edge", transform=edge))
    fates = {r.id: r.fate for r in out.collect()}
    assert {i for i, f in fates.items() if f == "future"} == {4, 11}
    assert {i for i, f in fates.items() if f == "late"} == {6, 8, 9}
    assert len(fates) == 11
    again = edge(frames[1], 1)  # a repeated batch is judged like the first time
    assert {r.id: r.fate for r in again.collect()} == {i: fates[i] for i in (5, 6, 7)}


def test_burn_of_windows_equals_cost_burn(spark, tmp_path):
    dice = random.Random(2)
    rows = []
    for n in range(400):
        price = dice.choice([None, 0.0, -1.0, 0.25, 0.5, 0.75, 3.0, 40.0])
        rows.append((n, dice.choice(["a", "b", "c", "d", None]), 1_700_000_100 + dice.randrange(9000), price))
    costs = spark.createDataFrame(rows, "seq bigint, session_id string, recorded_at_secs bigint, observed_billing_usd double")
    timed = costs.withColumn("event_time", F.timestamp_seconds("recorded_at_secs"))
    stream = arriving(spark, str(tmp_path / "in"), [timed.where(f"seq % 3 = {i}") for i in range(3)])
    path = run_available(windows.price_histogram_stream(stream, delay="1 day"), "prices", "update")
    newest = windows.latest_rows(spark.read.parquet(path), ["window_start", "session_id", "price"])
    found = {r.start: r for r in windows.burn_of_windows(newest).withColumn("start", F.unix_seconds("window_start")).collect()}
    assert len(found) > 30
    for start in sorted(found)[::9]:
        want = usage.cost_burn(costs, start + 3599, window=3599).first().asDict()
        got = found[start].asDict()
        assert {k: round(v, 9) for k, v in want.items()} == {k: round(got[k], 9) for k in want}


def test_slides_hold_what_sliding_windows_hold(spark, tmp_path):
    """State has a turn once, not once per window; late turns count where Spark's own windows count them."""
    from convlytics.operators.usage import session_price

    dice = random.Random(6)
    rows = []
    for n in range(600):
        late = dice.choice([0, 0, 300, 900, 2500, 4000, 9000])
        at = None if n % 40 == 7 else 1_700_000_000 + n * 30 - late
        rows.append((n, dice.choice(["a", "b", None]), dice.choice([None, -1.0, 0.1, 0.3, 0.7, 2.5]), at))
    timed = spark.createDataFrame(rows, "seq bigint, session_id string, observed_billing_usd double, secs bigint").withColumn(
        "event_time", F.timestamp_seconds("secs")
    )
    stream = arriving(spark, str(tmp_path / "in"), [timed.where(f"seq div 75 = {i}") for i in range(8)])
    priced = stream.where("session_id IS NOT NULL AND observed_billing_usd IS NOT NULL").withWatermark("event_time", "10 minutes")
    plain = priced.groupBy(F.window("event_time", "1 hour", "5 minutes").alias("w"), "session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(session_price()).alias("usd")
    ).select("w.start", "session_id", "turns", "usd")
    want = windows.latest_rows(spark.read.parquet(run_available(plain, "plain", "update")), ["start", "session_id"])
    want = {(r.start, r.session_id): (r.turns, round(r.usd, 9)) for r in want.collect()}

    sums = ["priced_turns", "observed_billing_usd"]
    stored = spark.read.parquet(run_available(windows.cost_burn_stream(stream), "slides", "update"))
    assert stored.select("window_start", "session_id").distinct().count() < len(want)
    slides = windows.added_rows(stored, ["window_start", "session_id"], sums)
    got = windows.sliding(slides, ["session_id"], sums).collect()
    assert {(r[0], r[1]): (r[2], round(float(r[3]), 9)) for r in got} == want
    assert len(want) > 90 and sum(t for t, _ in want.values()) < 12 * stored.agg(F.sum("priced_turns")).first()[0]


def test_a_streamed_ledger_repeats_no_row(spark, tmp_path):
    """A batch whose commit was lost runs again into its own folder, in its old place."""
    from convlytics.sources import ledgers
    from registry.queries import lose_commit

    row = lambda n: (n, "open_ai", "m", (n, n))
    schema = "schema_version int, provider string, model string, usage struct<input_tokens: bigint, output_tokens: bigint>"
    frames = [spark.createDataFrame([row(i * 10 + j) for j in range(10)], schema) for i in range(3)]
    folder, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    ledgers.stream_ledger(arriving(spark, folder, frames[:2]), ledger).awaitTermination()
    before = sorted(p.name for p in (tmp_path / "ledger").iterdir())
    ledgers.append_ledger(spark.createDataFrame([row(99)], schema), ledger)  # another writer
    lose_commit(spark, ledgers.ledger_checkpoint(spark, ledger), 1)
    ledgers.stream_ledger(arriving(spark, folder, frames[2:]), ledger).awaitTermination()
    assert len(before) == 2 and set(before) < {p.name for p in (tmp_path / "ledger").iterdir()}
    rows = ledgers.read_costs(spark, ledger).orderBy("seq").collect()
    assert [r.schema_version // 10 for r in rows] == [0] * 10 + [1] * 10 + [9] + [2] * 10
    assert sorted(r.schema_version for r in rows) == [*range(30), 99]


def test_the_served_log_forgets(spark, tmp_path):
    from convlytics.streaming.retention import RetainedLog, retain_stream

    day, now = 86_400, [40 * 86_400]
    log = RetainedLog(spark, str(tmp_path / "log"), max_age=10 * day, clock=lambda: now[0])
    rows = [[("a", 31 * day), ("b", 40 * day), ("c", None), ("d", 41 * day), ("e", 20 * day)], [("f", 36 * day + 5), ("g", 30 * day)]]
    frames = [spark.createDataFrame(r, "digest string, served_at_secs bigint") for r in rows]
    for part in frames:
        retain_stream(arriving(spark, str(tmp_path / "in"), [part]), log, str(tmp_path / "progress")).awaitTermination()
    kept = lambda: {r.digest for r in log.entries().collect()}
    assert kept() == {"a", "b", "c", "f", "g"}
    log.store(frames[1], 1)  # a repeated batch overwrites itself
    assert log.entries().count() == 5
    now[0] = 46 * day + 5
    assert kept() == {"b", "c", "f"} and log.expire() == 2
    now[0] = 90 * day
    assert log.expire() == 2 and kept() == {"c"}


def test_a_restarted_sink_repeats_no_row(spark, tmp_path):
    """A batch whose commit was lost runs again and overwrites itself."""
    import shutil

    frames = [spark.range(i * 10, i * 10 + 10).coalesce(1) for i in range(3)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_batches(arriving(spark, folder, frames[:2]), out).awaitTermination()
    shutil.copytree(f"{out}-checkpoint", tmp_path / "kept")
    for name in ("commits", "offsets"):
        (tmp_path / "kept" / name / "1").unlink()
        (tmp_path / "kept" / name / ".1.crc").unlink(missing_ok=True)
    shutil.copytree(tmp_path / "kept", tmp_path / "out2-checkpoint")
    shutil.copytree(out, tmp_path / "out2")
    write_batches(arriving(spark, folder, frames[2:]), str(tmp_path / "out2")).awaitTermination()
    got = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out2")).collect())
    assert got == list(range(30))
