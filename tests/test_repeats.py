import random
from collections import defaultdict

from pyspark.sql import functions as F

from convlytics.operators import repeats

SCHEMA = (
    "session_id string, seq bigint, session_turn bigint, event_key string, kind string, call_key string,"
    " tool string, tokens array<string>, is_edit boolean, digest string, wire_cheap boolean, failed boolean"
)


def call(seq, turn, key, link, tokens, tool="edit", edit=True, session="s"):
    return (session, seq, turn, key, "call", link, tool, tokens, edit, None, False, False)


def result(seq, turn, key, link, digest, cheap=False, failed=False, session="s"):
    return (session, seq, turn, key, "result", link, None, None, False, digest, cheap, failed)


def test_exact_near_and_cycle(spark):
    rows = [
        call(1, 1, "call-1", "edit-1", ["file", "src", "line", "one"]),
        result(2, 1, "result-1", "edit-1", "a", failed=True),
        call(3, 2, "call-2", "edit-2", ["file", "src", "line", "two"]),
        result(4, 2, "result-2", "edit-2", "a", cheap=True),
        result(5, 3, "result-2", "edit-2", "a", cheap=True),
    ]
    got = repeats.thrash_receipts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 1
    row = got[0]
    assert row.session_turn == 2 and row.score == 3
    assert (row.near_repeated_tool_calls, row.edit_fail_edit_cycles, row.exact_repeated_tool_results) == (1, 1, 1)
    assert (row.wire_cheap_exact_repeated_tool_results, row.expensive_exact_repeated_tool_results) == (1, 0)


def observe(events):
    """One pass over the events of a session, in order."""
    out = defaultdict(lambda: [0, 0, 0, 0])
    seen, digests, prior, edits, pending, latest = set(), set(), [], set(), False, None
    for e in events:
        (_, _, turn, key, kind, link, tool, tokens, is_edit, digest, cheap, failed) = e
        if key in seen:
            continue
        seen.add(key)
        if kind == "call":
            tokens = set(tokens)
            if any(t == tool and p != tokens and len(p & tokens) / len(p | tokens) >= 0.6 for t, p in prior[-128:]):
                out[turn][2] += 1
            if is_edit and pending:
                out[turn][3] += 1
                pending = False
            if is_edit:
                edits.add(link)
            prior.append((tool, tokens))
            latest = link
        else:
            if digest in digests:
                out[turn][0] += 1
                out[turn][1] += bool(cheap)
            digests.add(digest)
            if failed and (link or latest) in edits:
                pending = True
    return {t: tuple(v) for t, v in out.items() if v[0] or v[2] or v[3]}


def random_events(seed, sessions, n):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        session = "hot" if rng.random() < 0.7 else f"s{rng.randrange(sessions)}"
        turn = seq // 10
        key = f"e{rng.randrange(n * 4)}"
        if rng.random() < 0.55:
            tokens = [f"t{rng.randrange(7)}" for _ in range(rng.randrange(1, 6))]
            tool = rng.choice(["edit", "read"])
            rows.append(call(seq, turn, key, f"c{seq}", tokens, tool, tool == "edit", session))
        else:
            link = rng.choice([None, f"c{rng.randrange(max(seq, 1))}"])
            rows.append(result(seq, turn, key, link, f"d{rng.randrange(40)}", rng.random() < 0.3, rng.random() < 0.5, session))
    return rows


def want(rows):
    by_session = defaultdict(list)
    for r in rows:
        by_session[r[0]].append(r)
    return {(s, t): v for s, events in by_session.items() for t, v in observe(events).items()}


def found(df):
    return {
        (r.session_id, r.session_turn): (
            r.exact_repeated_tool_results, r.wire_cheap_exact_repeated_tool_results,
            r.near_repeated_tool_calls, r.edit_fail_edit_cycles,
        )
        for r in df.collect()
    }


def test_against_one_ordered_pass(spark):
    rows = random_events(4, 6, 500)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    assert found(repeats.thrash_receipts(spark.createDataFrame(shuffled, SCHEMA))) == want(rows)


def test_small_blocks_change_nothing(spark):
    rows = random_events(9, 3, 400)
    df = spark.createDataFrame(rows, SCHEMA)
    few = repeats.near_repeats(df, prior=5, block_rows=8)
    whole = repeats.near_repeats(df, prior=5)
    assert sorted(r.seq for r in few.collect()) == sorted(r.seq for r in whole.collect())
    assert few.count() == few.select("session_id", "seq").distinct().count()
    a = repeats.link_results(df, span=16).orderBy("seq").select("seq", "call_key").collect()
    assert a == repeats.link_results(df).orderBy("seq").select("seq", "call_key").collect()


def test_edit_tools(spark):
    df = spark.createDataFrame([("Apply_Patch",), ("grep",), ("WRITE",)], "t string")
    assert [r[0] for r in df.select(repeats.is_edit_tool(F.col("t"))).collect()] == [True, False, True]


def streamed(spark, folder, rows, batches, at, **options):
    """Receipts of the keyed stream over several micro-batches; ``at`` gives the second of a row."""
    from convlytics.streaming.repeats import COUNTS, thrash_stream
    from convlytics.streaming.sink import run_available, stateful_session

    session = stateful_session(spark)
    timed = [(*r, at(r)) for r in rows]
    df = session.createDataFrame(timed, f"{SCHEMA}, secs bigint").withColumn("event_time", F.timestamp_seconds("secs"))
    for part in range(batches):
        df.where(f"seq div {-(-len(rows) // batches)} = {part}").coalesce(1).write.mode("append").parquet(folder)
    stream = session.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = spark.read.parquet(run_available(thrash_stream(stream, **options), "thrash")).drop("batch")
    return out.groupBy("session_id", "session_turn").agg(*[F.sum(c).alias(c) for c in COUNTS])


def test_stream_equals_batch(spark, tmp_path):
    """Three micro-batches with keyed state give the receipts of one batch."""
    rows = random_events(12, 4, 240)
    assert found(streamed(spark, str(tmp_path / "in"), rows, 3, lambda r: 1_700_000_000 + r[1])) == want(rows)


def test_idle_sessions_are_forgotten(spark, tmp_path):
    """Each batch comes hours after the one before: it is compared with nothing older."""
    rows = random_events(21, 2, 160)
    parts = [[r for r in rows if r[1] // 40 == part] for part in range(4)]
    got = streamed(spark, str(tmp_path / "in"), rows, 4, lambda r: 1_700_000_000 + r[1] // 40 * 20_000 + r[1], ttl=3600)
    apart = {}
    for part in parts:
        apart.update(want(part))  # turns of ten events lie inside one batch
    assert found(got) == apart != want(rows)


def test_long_sessions_keep_their_state_in_parts(spark, tmp_path):
    """State is read and written by parts, not by value, and parts stay small as a session grows."""
    from convlytics.streaming.repeats import _PART, _Seen

    class Counted(dict):
        asked = 0

        def getValue(self, key):
            self.asked += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.asked += 1
            self[key] = value

    state, parts, size = Counted(), 1, 0
    for batch in range(20):
        seen = _Seen(state, parts, size)
        names = [f"v{n % 5000}" for n in range(batch * 300, batch * 300 + 600)]
        assert [seen.add("k", n) for n in names] == [n >= (300 if batch else 0) and batch * 300 + n < 5000 for n in range(600)]
        seen.store()
        parts, size = seen.parts, seen.size
    assert size == 5000 == sum(len(v[0]) for v in state.values()) and state.asked < 20 * 600 / 5
    assert max(len(v[0]) for v in state.values()) < 2 * _PART
    rows = random_events(8, 1, 900)
    assert found(streamed(spark, str(tmp_path / "in"), rows, 3, lambda r: 1_700_000_000 + r[1])) == want(rows)


def test_replays_are_looked_for_once(spark):
    rows = [call(1, 1, "a", "a", ["x"]), result(2, 1, "b", "a", "d"), result(3, 1, "c", "a", "d"), result(4, 2, "c", "a", "d")]
    found = repeats.thrash_receipts(spark.createDataFrame(rows, SCHEMA))
    leaves = found._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert all(leaves.apply(i).toString().startswith("Relation [") for i in range(leaves.size()))
    assert [(r.session_turn, r.score) for r in found.collect()] == [(1, 1)]
