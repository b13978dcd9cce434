import random

from frame_values import values
from pyspark.sql import functions as F

from convlytics.operators import health, lint, render, signals

RENDERED = [
    ("x64 box\n--dry-run\n. sent", "x64 box\n--dry-run\n**Done.** sent"),
    ("\\§ 12 of the act\n. read", "§ 12 of the act\n**Done.** read"),
    ("```sql\n*as is\n|x|y|z\n```\n. ran", "```sql\n*as is\n|x|y|z\n```\n**Done.** ran"),
    ("|Item|Price\n|tea\n. paid", "|Item|Price\n|tea\n**Done.** paid"),
    ("§ Plan\n- *hold\n--# one\n. closed", "## Plan\n- **hold**\n  1. one\n**Done.** closed"),
    ("|Item|Price\n|tea|3", "|Item|Price|\n|---|---:|\n|tea|3|"),
    (". first\nbody\n", ". first\nbody\n"),
    (". last\n\n  \n", "**Done.** last\n\n  \n"),
    ("- a\n--- jump\n-- b", "- a\n--- jump\n-- b"),
    ("-! stop\n--~ hint\n---> quote", "> **Blocking:** stop\n  > Note: hint\n    > quote"),
    ("a `*b` *c `open *d", "a `*b` **c** `open *d"),
    ("|a|b|\n|1|2|", "|a|b|\n|1|2|"),
    ("|a|b\r\n|1|x\r\n", "|a|b|\n|---:|---|\n|1|x|\n"),
    ("", ""),
    ("x blocked\r", "**Blocked:** blocked\r"),
    ("- *word tail *kept", "- **word** tail *kept"),
]


def test_rendering(texts):
    got = values(render.render_responses(texts([t for t, _ in RENDERED], "content")), "rendered")
    assert got == [r for _, r in RENDERED]


def test_restoring_is_the_inverse(texts, spark):
    df = texts([t for t, _ in RENDERED], "content").withColumnRenamed("id", "seq")
    assert render.roundtrip_audit(df).where("NOT identical").count() == 0


MARKED = [
    "§ Plan\n. closed", "? which one; options: b", "- bullet", "-# ordered", "|a|b\n|1|2", "*word emphasized",
    "! blocking\n~ note", "\\*word", "a\n. done\n\n", "text `code` *em",
]
UNMARKED = [
    "nothing special here", "x64 box\n--- jump\nonly words", "\\§ 12 of the act", "two * three",
    "x = 5 is wrong\nplain prose", ". done\nmore", "```\n§ fenced\n```", "|a|b|\n|1|2|", "", "`open *x", "-- deep",
]


def test_uses_markers(texts):
    df = texts(MARKED + UNMARKED).select("id", health.uses_markers(F.col("text")).alias("u"))
    assert values(df, "u") == [True] * len(MARKED) + [False] * len(UNMARKED)


def test_table_counters(texts):
    df = health.format_counters(texts(["|a|b\n|1|2", "|a|b\n|1", "```\n|a|b\n|1\n```", "|a\n|b\n\n|c\n"]), "text")
    rows = df.orderBy("id").collect()
    assert [(r.table_runs, r.malformed_table_runs) for r in rows] == [(1, 0), (1, 1), (0, 0), (2, 1)]


def test_marker_use_agrees_with_rendering(texts):
    """A text that renders differently uses markers."""
    rng = random.Random(5)
    pieces = ["§ a", ". b", "? c", "x d", "- e", "-- f", "|g|h", "|1|2", "|i|", "```", "*j k", "plain", "", "`l *m", "> n"]
    samples = ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    df = texts(samples).select("id", "text", health.uses_markers(F.col("text")).alias("u"), render.render(F.col("text")).alias("r"))
    # A quote line and a first-level bullet render to themselves and still count.
    wrong = df.where("(r <> text) AND NOT u").collect()
    assert wrong == []


def test_model_and_format_health(spark):
    def row(seq, version, text, zero, tables, bad):
        return (seq, "openai", "m", version, 0, 0, text, zero, tables, bad)

    schema = (
        "seq bigint, provider string, model string, skill_version string, substitution_attempts bigint,"
        " substitution_misses bigint, text_responses bigint, zero_sigil_responses bigint, table_runs bigint,"
        " malformed_table_runs bigint"
    )
    df = spark.createDataFrame(
        [row(5, "1.1.0", 40, 7, 10, 1), row(1, "1.0.1", 20, 2, 5, 0), row(2, "1.0.1", 20, 2, 5, 0), row(3, None, 9, 9, 0, 0), row(4, " ", 9, 9, 0, 0), row(9, "1.2.0", 39, 0, 0, 0)],
        schema,
    )
    got = {r.skill_version: r for r in health.format_assessment(health.format_health(df)).collect()}
    assert set(got) == {"1.0.1", "1.1.0", "1.2.0"}
    assert got["1.0.1"].assessment == "no_baseline"
    assert got["1.1.0"].assessment == "rollback_recommended" and got["1.1.0"].baseline_skill_version == "1.0.1"
    assert got["1.2.0"].assessment == "insufficient_samples"
    total = health.model_health(df).first()
    assert total.text_responses == 137 and total.miss_rate is None


def test_probe(texts):
    samples = ["A plain response without wire markers.", "§ Status\n. done", ". first\nbody after", "```\n. literal\n```", "|a|\n-x\n```"]
    rows = health.probe_compliance(texts(samples, "content")).orderBy("id").collect()
    assert [(r.zero_sigil, r.malformed) for r in rows] == [(True, False), (False, False), (False, True), (True, False), (True, True)]
    assert rows[4].malformed_reasons == ["ambiguous dash prefix", "trailing table separator", "unterminated fence"]


# -------------------------------------------------------------------------------- lint

PARALLEL = "Cache reads retain stable prefixes.\nCache reads reduce repeated input cost.\nCache reads expose prefix churn.\n"


def rules(df):
    out = {}
    for r in lint.lint_documents(df, ["id"]).collect():
        out.setdefault(r.id, []).append((r.rule, r.line))
    return out


def test_lint_rules(texts):
    samples = [
        "`opaque_identifier` has value\n.",
        "Thing unusual surprising outcome\n.",
        PARALLEL + ". done",
        "- " + PARALLEL.replace("\nC", "\n- C") + ". done",
        "```text\n" + PARALLEL + "```\n. done",
        "§ Status\n. done",
        "## Status\n**Done.** done",
        "! must fix the config\n. done",
        "~ should run the migration\n. done",
        "blocking: must fix the config\n. done",
        "Sure thing, got it. Perhaps maybe it might\n. done",
        "text\n```\nab\n```\n" + PARALLEL + ". done",
    ]
    got = rules(texts(samples))
    has = lambda i, rule: rule in [r for r, _ in got.get(i, [])]
    assert not has(0, "B5") and has(1, "B5")
    assert ("F4", 1) in got[2] and not has(3, "F4") and not has(4, "F4")
    assert ("F4", 5) in got[11]
    assert not has(5, "G1") and has(6, "G1")
    assert not has(7, "R3") and not has(8, "R3") and has(9, "R3")
    assert {"B2", "B4", "R8"} <= {r for r, _ in got[10]}


def test_overlap_looks_past_user_turns_and_sessions(spark):
    rows = [
        ("s", 1, "assistant", "unusual overlapping repeated wording here\n. done"),
        ("s", 2, "user", "totally different unrelated reply"),
        ("s", 3, "assistant", "unusual overlapping repeated wording again\n. done"),
        ("t", 4, "assistant", "unusual overlapping repeated wording\n. done"),
    ]
    df = spark.createDataFrame(rows, "session_id string, seq bigint, role string, content string")
    assert [r.seq for r in lint.turn_overlap(df).collect()] == [3]
    assert sorted(r.seq for r in lint.turn_overlap(df, per_session=False).collect()) == [3, 4]
    assert lint.lint_transcript(df).where("rule = 'B3/G2'").count() == 1


# ----------------------------------------------------------------------------- signals

def test_readiness_scores(spark):
    rows = [
        (1, "user", "Fix src/lib.rs. Done when tests pass."),
        (2, "user", "There is a bug and it fails"),
        (3, "user", "hm"),
        (4, "user", "Add docs.\n\n```\ncode;\n```"),
    ]
    df = spark.createDataFrame(rows, "seq bigint, role string, content string")
    got = {(r.seq, r.variant): r for r in signals.readiness(df).collect()}
    raw = got[1, "raw_composite"]
    assert raw.score == 75 and raw.slots.environment_reproduction == "not_applicable"
    assert raw.reasons == ["no_constraints"]
    assert got[2, "raw_composite"].slots.environment_reproduction == "missing"
    assert got[3, "raw_composite"].score == 0
    assert got[4, "trailing_prose"].slots.task == "present"


def test_terminal_states(spark):
    rows = [("a\n. done\n\n",), ("? which",), ("x stuck",), ("plain",), ("x86",), ("",)]
    df = spark.createDataFrame(rows, "content string").withColumn("id", F.monotonically_increasing_id())
    got = signals.terminal_state(df).orderBy("id").collect()
    assert [r.state for r in got] == ["done", "decision", "blocked", "missing", "missing", "missing"]


def test_stored_terminal_wins(spark):
    df = spark.createDataFrame([(1, "assistant", ". done", False), (2, "assistant", "? q", False)], "seq bigint, role string, content string, conversation_start boolean")
    stored = signals.with_receipts(df).withColumn("content", F.lit("x other"))
    assert values(signals.terminal_state(stored), "state", "seq") == ["done", "decision"]


def test_blocked_cause(texts):
    df = texts(["x No access to The DB", "x a b", "fine", "x \n\n"]).select("id", signals.blocked_cause(F.col("text")).alias("c"))
    assert values(df, "c") == ["access the", None, None, None]


def test_arms_follow_the_hash(spark):
    import hashlib

    rows = [(f"s{i}", i, "user", True) for i in range(40)] + [(f"s{i}", 100 + i, "user", True) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id string, seq bigint, role string, conversation_start boolean")
    got = {r.session_id: r for r in signals.assign_arms(df, "raw_composite", evidence_id="stage-1").collect()}
    assert len(got) == 40 and all(r.seq < 40 for r in got.values())
    for name, r in got.items():
        even = ord(hashlib.sha256(name.encode()).hexdigest()[0]) % 2 == 0
        assert r.injected == even and r.arm == ("inject" if even else "record_only")
    for refused in ({"injection_enabled": False}, {"randomized": False}, {"template_version": 2}, {"evidence_id": None}, {"evidence_id": " "}):
        assert signals.assign_arms(df, "raw_composite", **{"evidence_id": "stage-1", **refused}).where("injected").count() == 0
    assert signals.assign_arms(df, None).count() == 0
