import random
import statistics

import numpy as np
import pytest

from convlytics.operators import evaluate


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 10), ("a", 20), ("a", None), ("b", 5)], "arm string, tokens bigint")
    got = {r.arm: r.p for r in evaluate.percentile_linear(df, ["arm"], "tokens", 0.5, "p").collect()}
    assert got == {"a": 6.0, "b": 5.0}


def test_paired_summary(spark):
    df = spark.createDataFrame([("on", 1, None), ("on", 3, None), ("off", 4, 0.5), ("off", None, 0.25)], "arm string, tokens bigint, estimated_cost double")
    got = {r.arm: r for r in evaluate.paired_summary(df).collect()}
    assert got["on"].total_estimated_cost is None and got["on"].median_tokens == 2.0 and got["off"].runs == 2
    assert got["off"].total_estimated_cost == 0.75


@pytest.mark.parametrize("n", [5, 40, 101])
def test_bootstrap_agrees_with_resampling(spark, n):
    rng = random.Random(n)
    data = [rng.randrange(100, 400) for _ in range(n)]
    df = spark.createDataFrame([("a", x) for x in data] + [("few", 1)] * 4, "arm string, tokens bigint")
    got = {r.arm: r for r in evaluate.bootstrap_median_ci(df, reps=2000, seed=3).collect()}
    assert got["few"].low is None and got["few"].median == 1.0
    draws = np.random.default_rng(0).choice(data, size=(4000, n))
    low, high = np.percentile(np.median(draws, axis=1), [2.5, 97.5])
    assert got["a"].median == statistics.median(data)
    spread = max(data) - min(data)
    assert abs(got["a"].low - low) <= 0.08 * spread and abs(got["a"].high - high) <= 0.08 * spread
    again = {r.arm: r for r in evaluate.bootstrap_median_ci(df.repartition(3), reps=2000, seed=3).collect()}
    assert (again["a"].low, again["a"].high) == (got["a"].low, got["a"].high)


def test_terms_and_structure(spark):
    cases = spark.createDataFrame([("c", ["Admin", "active"])], "case_id string, required_terms array<string>")
    rows = [("c", "x", "ADMIN is Active\n- item\n  1. one\n§x", 1, 2, 0.5), ("c", "y", "admin", 1, 2, 0.25)]
    df = spark.createDataFrame(rows, "case_id string, arm string, content string, prompt_tokens int, output_tokens int, estimated_billing_usd double")
    covered = evaluate.term_coverage(df, cases)
    got = {r.arm: r for r in covered.collect()}
    assert got["x"].quality_floor_passed and got["x"].structure_lines == 3
    assert got["y"].required_found == 1 and not got["y"].quality_floor_passed
    assert {r.arm: r.passed for r in evaluate.coverage_summary(covered).collect()} == {"x": 1, "y": 0}


def test_budget(spark):
    df = spark.createDataFrame([("r", i, 0.25) for i in range(6)], "run string, seq bigint, estimated_billing_usd double")
    row = evaluate.cutoff_summary(evaluate.budget_cutoff(df, 1.0, ["run"]), ["run"]).first()
    assert (row.cutoff_seq, row.runs_within_cap, row.spent_within_cap) == (4, 4, 1.0)
    assert evaluate.budget_cutoff(df, 1.0).where("over_cap").count() == 2
