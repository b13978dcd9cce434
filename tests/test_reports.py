import pytest
from pyspark.sql import functions as F

from convlytics.operators import reports, signals

COST = "session_id string, session_turn bigint, observed_billing_usd double"
LABEL = "session_id string, completed boolean, correct boolean"


def turns(spark, rows, start=True):
    """(session, seq, turn, role, content)"""
    df = spark.createDataFrame(rows, "session_id string, seq bigint, session_turn bigint, role string, content string")
    return signals.with_receipts(df.withColumn("conversation_start", F.lit(start)))


def test_readiness_observations(spark):
    df = turns(spark, [
        ("s1", 1, 1, "user", "Fix src/lib.rs. Preserve compatibility. Done when tests pass."),
        ("s1", 2, 1, "assistant", ". done"),
        ("s2", 3, 1, "user", "Explain this."),
        ("s1", 4, 2, "user", "later turn"),
    ])
    costs = spark.createDataFrame([("s1", 1, 0.02), ("s2", 1, 0.03)], COST)
    labels = spark.createDataFrame([("s1", True, True)], LABEL)
    obs = reports.readiness_observations(df, costs, labels)
    got = {(r.session_id, r.variant): r for r in obs.collect()}
    assert len(got) == 4
    raw = got["s1", "raw_composite"]
    assert raw.turns == 3 and raw.observed_billing_usd == pytest.approx(0.02) and raw.correct and raw.score == 100
    assert not got["s2", "raw_composite"].labelled
    assert reports.unlabelled_sessions(obs).first()[0] == 1


def test_non_start_and_legacy_receipts_are_left_out(spark):
    costs, labels = spark.createDataFrame([], COST), spark.createDataFrame([], LABEL)
    for start in (False, None):
        df = turns(spark, [("c", 1, 1, "user", "Continue the task.")], start)
        assert reports.readiness_observations(df, costs, labels).count() == 0


def test_no_evidence_stops(spark):
    df = turns(spark, [("c", 1, 1, "user", "Continue the task.")])
    costs, labels = spark.createDataFrame([], COST), spark.createDataFrame([], LABEL)
    obs = reports.readiness_observations(df, costs, labels)
    assert reports.held_out_analysis(obs).first().decision == "stop_insufficient_evidence"
    assert sorted(r.variant for r in reports.held_out_variants(obs).collect()) == sorted(signals.VARIANTS)
    assert reports.experiment_report(df, costs, labels).count() == 2
    assert reports.experiment_decision(df, costs, labels).first().decision == "stop_insufficient_evidence"


def test_held_out_selection_prefers_the_larger_gap(spark):
    ids = [f"id{i}" for i in range(400)]
    df = spark.createDataFrame([(i, 1) for i in ids], "session_id string, turns bigint")
    both = df.crossJoin(spark.createDataFrame([(v,) for v in signals.VARIANTS], "variant string"))
    n = F.abs(F.hash("session_id")) % 10
    obs = both.select(
        "session_id", "turns", "variant", (n * 10).cast("int").alias("score"), F.lit(True).alias("completed"),
        (n >= 5).alias("correct"), (1.0 - n / 10).alias("observed_billing_usd"), F.lit(True).alias("labelled"),
    )
    assert reports.held_out_analysis(obs).first().decision == "select_trailing_prose"
    worse = obs.withColumn("score", F.when(F.col("variant") == "trailing_prose", F.col("score") % 20).otherwise(F.col("score")))
    assert reports.held_out_analysis(worse).first().decision == "select_raw_composite"
    flat = obs.withColumn("score", F.lit(50))
    assert reports.held_out_analysis(flat).first().decision == "stop_no_predictive_variant"
    row = reports.held_out_variants(flat).first()
    assert row.score_correctness_correlation is None


def test_experiment_excludes_mixed_unlabelled_and_unbilled(spark):
    def with_arms(rows):
        df = spark.createDataFrame(rows, "session_id string, seq bigint, arms array<string>")
        return df.withColumn(
            "receipts", F.transform("arms", lambda a: signals.receipt(signal=F.lit("advisory"), arm=a))
        )

    rows = [("both", 1, ["inject"]), ("both", 2, ["record_only"]), ("nolabel", 3, ["inject"]), ("nocost", 4, ["inject"]),
            ("free", 5, ["inject"]), ("paid", 6, ["record_only"]), ("paid", 7, []), ("none", 8, [])]
    costs = spark.createDataFrame([("both", 1, 1.0), ("nolabel", 1, 1.0), ("free", 1, 0.0), ("paid", 1, 2.0), ("paid", 2, -5.0)], COST)
    labels = spark.createDataFrame([(s, True, None) for s in ("both", "nocost", "free", "paid")], LABEL)
    got = {r.arm: r for r in reports.experiment_report(with_arms(rows), costs, labels).collect()}
    assert (got["inject"].assigned_sessions, got["inject"].eligible_sessions) == (3, 1)
    assert got["record_only"].billed_dollars_per_completed_task == 2.0 and got["record_only"].diagnostic_mean_turns == 2.0
    assert got["record_only"].correct_sessions == 0
    assert reports.experiment_decision(with_arms(rows), costs, labels).first().excluded_sessions == 3


def test_clarification(spark):
    df = turns(spark, [
        ("s", 1, 1, "user", "Fix the bug."),
        ("s", 2, 1, "assistant", "? Which target file and acceptance check apply?"),
        ("s", 3, 2, "user", "Fix the bug in src/lib.rs. Preserve compatibility. Done when cargo test passes."),
    ], start=None)
    costs = spark.createDataFrame([("s", 2, 0.02)], COST)
    labels = spark.createDataFrame([("s", True, True)], LABEL)
    rows = {r.variant: r for r in reports.clarifications(df, costs, labels).collect()}
    raw = rows["raw_composite"]
    assert len(rows) == 2 and (raw.question_turn, raw.reply_turn) == (1, 2) and raw.score_delta > 0
    assert {"target_artifact", "success_criterion", "constraints"} <= set(raw.filled_slots)
    assert raw.reply_turn_observed_billing_usd == pytest.approx(0.02) and raw.reply_turn_priced_cost_records == 1
    summary = reports.clarification_summary(df, costs, labels).first()
    assert (summary.unpaired_decision_turns, summary.incomplete_readiness_pairs) == (0, 0)


def test_clarification_counters(spark):
    costs, labels = spark.createDataFrame([], COST), spark.createDataFrame([], LABEL)
    df = turns(spark, [
        ("nousers", 1, 1, "assistant", "? need detail"),
        ("legacy", 2, None, "assistant", "? old"),
        ("noreply", 3, 1, "user", "Fix it."), ("noreply", 4, 1, "assistant", "? q"), ("noreply", 5, 1, "assistant", "? same turn"),
        ("early", 6, 1, "assistant", "? q"), ("early", 7, 2, "user", "Fix it."),
    ])
    bare = spark.createDataFrame([("half", 8, 1, "user", "hi"), ("half", 9, 1, "assistant", "? q"), ("half", 10, 2, "user", "ok")], "session_id string, seq bigint, session_turn bigint, role string, content string")
    half = signals.with_receipts(bare.withColumn("conversation_start", F.lit(True)))
    half = half.withColumn("receipts", F.when(F.col("seq") == 8, F.slice("receipts", 1, 1)).otherwise(F.col("receipts")))
    row = reports.clarification_summary(df.unionByName(half), costs, labels).first()
    # No user rows and no reply: unpaired.  No earlier user turn, or one variant missing: incomplete.
    assert row.unpaired_decision_turns == 2
    assert row.incomplete_readiness_pairs == 2
    assert row.legacy_records_excluded == 1 and row.observations == 1


def test_trajectories(spark):
    rows = [("s", i, i, "assistant", c) for i, c in enumerate(["? a", "? b", "? c", "x no access yet", "x no access yet"])]
    rows += [("s", 9, 9, "user", "hi"), ("u", 10, 1, "user", "only a user"), ("ok", 11, 1, "assistant", "? a"), ("ok", 12, 2, "assistant", ". done"), ("ok", 13, 3, "assistant", "? a"), ("ok", 14, 4, "assistant", "? a")]
    df = turns(spark, rows)
    costs = spark.createDataFrame([("s", 1, 0.5), ("s", 1, -9.0)], COST)
    got = {r.session_id: r for r in reports.terminal_trajectories(df, costs, spark.createDataFrame([], LABEL)).collect()}
    s = got["s"]
    assert s.decision_ping_pong and s.repeated_blocked_cause and s.long_run_without_done
    assert (s.turns, s.assistant_turns, s.observed_billing_usd) == (6, 5, 0.5)
    assert got["u"].assistant_turns == 0 and not got["u"].decision_ping_pong
    assert not got["ok"].decision_ping_pong and not got["ok"].long_run_without_done
    sequence = reports.terminal_sequence(df).where("session_id = 's'").orderBy("position").collect()
    assert [r.state for r in sequence] == ["decision"] * 3 + ["blocked"] * 2


def test_thrash_report(spark):
    fields = dict(zip(reports.THRASH_FIELDS, (4, 2, 1, 1, 1, 1)))
    df = spark.createDataFrame([("s",), ("quiet",)], "session_id string")
    one = F.array(signals.receipt(signal=F.lit("thrash"), **{k: F.lit(v) for k, v in fields.items()}))
    df = df.withColumn("receipts", F.when(F.col("session_id") == "s", one).otherwise(F.slice(one, 1, 0)))
    got = {r.session_id: r for r in reports.thrash_report(df, spark.createDataFrame([("s", 1, 0.02)], COST)).collect()}
    assert got["s"].score == 4 and got["s"].exact_repeated_tool_results == 2
    assert got["s"].observed_billing_usd == pytest.approx(0.02) and got["quiet"].score == 0
