from pyspark.sql import functions as F

from convlytics.operators import signals
from convlytics.operators.transcript import build_transcript


def test_rows_are_redacted_linted_and_receipted(spark):
    rows = [
        ("s", 1, 1, "user", "must fix token=abc now", True),
        ("s", 2, 1, "assistant", "must fix the config\npassword: hunter2", False),
        ("s", 3, 2, "user", "ok", False),
        ("s", 4, 2, "assistant", "§ fine\n. done", False),
    ]
    turns = spark.createDataFrame(
        rows, "session_id string, seq bigint, session_turn bigint, role string, content string, conversation_start boolean"
    )
    thrash = spark.createDataFrame(
        [("s", 2, 3, 1, 1, 0, 1, 1)],
        "session_id string, session_turn bigint, score int, exact_repeated_tool_results bigint,"
        " expensive_exact_repeated_tool_results bigint, wire_cheap_exact_repeated_tool_results bigint,"
        " near_repeated_tool_calls bigint, edit_fail_edit_cycles bigint",
    )
    out = build_transcript(turns, signals.assign_arms(turns, "raw_composite", evidence_id="stage-1"), thrash)
    got = {r.seq: r for r in out.orderBy("seq").collect()}
    assert got[1].content == "must fix token=[REDACTED] now" and got[1].lint == []
    assert [r.signal for r in got[1].receipts] == ["readiness", "readiness", "advisory"]
    assert got[2].content.endswith("password: [REDACTED]")
    assert {f.rule for f in got[2].lint} >= {"G1", "R3"}
    assert [r.signal for r in got[2].receipts] == ["terminal"] and got[2].receipts[0].state == "missing"
    assert [r.signal for r in got[3].receipts] == ["readiness", "readiness"]
    assert [r.signal for r in got[4].receipts] == ["thrash", "terminal"]
    assert got[4].receipts[0].score == 3 and got[4].receipts[1].state == "done"
    assert out.where(F.col("schema_version") != 2).count() == 0
