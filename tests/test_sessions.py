import random

import pytest
from pyspark.sql import functions as F

from convlytics.operators import sessions


def simulate(requests, ttl):
    """The registry rule itself: unique longest common prefix among live sessions."""
    live, names, out = {}, 0, {}
    for rid, at, history in requests:
        live = {k: (h, t) for k, (h, t) in live.items() if at - t <= ttl}
        common = {k: next((i for i, (a, b) in enumerate(zip(h, history)) if a != b), min(len(h), len(history))) for k, (h, _) in live.items()}
        longest = max(common.values(), default=0)
        best = [k for k, c in common.items() if c == longest and c > 0]
        if len(best) == 1:
            name, opened = best[0], False
        else:
            names += 1
            name, opened = names, True
        live[name] = (history, at)
        out[rid] = (name, opened)
    return out


@pytest.mark.parametrize("ttl", [0, 5, 40])
def test_stitching_equals_the_registry(spark, ttl):
    rng = random.Random(ttl)
    requests, at = [], 0
    for rid in range(300):
        at += rng.choice([0, 1, 2, 9])
        first = "hot" if rng.random() < 0.5 else f"m{rng.randrange(6)}"
        requests.append((rid, at, [first] + [rng.choice("xyz") for _ in range(rng.randrange(4))]))
    want = simulate(requests, ttl)
    rows = [(rid, rid, at, h[0]) for rid, at, h in requests]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "request_id bigint, seq bigint, at_secs bigint, first_message string")
    got = {r.request_id: r for r in sessions.stitch_sessions(df, ttl).collect()}
    names = {}
    for rid, (name, opened) in want.items():
        assert got[rid].opened == opened
        assert names.setdefault(name, got[rid].session_id) == got[rid].session_id
    assert len(set(names.values())) == len(names)


def test_requests_without_messages_stand_alone(spark):
    df = spark.createDataFrame([(1, 1, 0, None), (2, 2, 0, None)], "request_id bigint, seq bigint, at_secs bigint, first_message string")
    rows = sessions.stitch_sessions(df).collect()
    assert all(r.opened for r in rows) and len({r.session_id for r in rows}) == 2


def messages(spark, histories, owner):
    rows = [(name, i, m) for name, history in histories.items() for i, m in enumerate(history)]
    return spark.createDataFrame(rows, f"{owner} string, pos bigint, message string")


def test_matching_takes_the_unique_longest_prefix(spark):
    stored = messages(spark, {"a": ["1", "2", "3"], "b": ["1", "2"], "c": ["9"], "d": ["9"], "e": ["7", "8"]}, "session_id")
    asked = messages(spark, {"r1": ["1", "2", "3", "4"], "r2": ["1", "2", "x"], "r3": ["9", "1"], "r4": ["0"], "r5": ["7"], "r6": ["2", "1"]}, "request_id")
    got = {r.request_id: (r.session_id, r.collision) for r in sessions.match_sessions(asked, stored).collect()}
    assert got == {"r1": ("a", False), "r2": (None, True), "r3": (None, True), "r4": (None, False), "r5": ("e", False), "r6": (None, False)}


def test_live_sessions(spark):
    df = spark.createDataFrame([("a", 0), ("b", 10), ("c", 20), ("c", 5), ("d", 20), ("late", 4000)], "session_id string, at_secs bigint")
    assert {r.session_id for r in sessions.live_sessions(df, 3610).collect()} == {"b", "c", "d", "late"}
    assert [r.session_id for r in sessions.live_sessions(df, 3610, cap=2).collect()] == ["late", "d"]


def test_turn_numbers(spark):
    df = spark.createDataFrame([("s", 5), ("t", 6), ("s", 9)], "session_id string, seq bigint")
    assert {(r.session_id, r.seq): r.session_turn for r in sessions.number_turns(df).collect()} == {("s", 5): 1, ("s", 9): 2, ("t", 6): 1}


def test_starts_and_last_user_text(spark):
    rows = [
        (1, 0, "system", "rules", "openai", True), (1, 1, "user", "hi", "openai", True),
        (2, 0, "user", "hi", "openai", True), (2, 1, "assistant", "yo", "openai", True), (2, 2, "tool", "out", "openai", True),
        (3, 0, "user", "", "anthropic", False), (4, 0, "user", "a\nb", "anthropic", False), (5, 0, "user", None, "openai", False),
    ]
    df = spark.createDataFrame(rows, "request_id int, pos int, role string, text string, provider string, is_plain_text boolean")
    starts = {r.request_id: r.conversation_start for r in sessions.conversation_start(df).collect()}
    assert starts == {1: True, 2: False, 3: True, 4: True, 5: True}
    assert {r.request_id: r.text for r in sessions.last_user_text(df).collect()} == {1: "hi", 4: "a\nb"}


def test_session_windows_merge_a_gap_of_exactly_the_ttl(spark, tmp_path):
    from convlytics.streaming.sink import run_available
    from convlytics.streaming.windows import session_stream

    rows = [(1, "m", 10), (2, "m", 3610), (3, "m", 7211), (4, "n", 3610)]
    df = spark.createDataFrame(rows, "seq bigint, first_message string, at bigint").select(
        "seq", "first_message", F.timestamp_seconds("at").alias("event_time")
    )
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    path = run_available(session_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "s", "complete")
    assert sorted((r.first_seq, r.requests) for r in spark.read.parquet(path).collect()) == [(1, 2), (3, 1), (4, 1)]
