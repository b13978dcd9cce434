import random

import pytest
from pyspark.sql import types as T

from convlytics.operators import usage
from convlytics.sources import schemas
from convlytics.sources.ledgers import pricing_dim


def approx(x):
    return pytest.approx(x, abs=1e-12)


def test_normalize_usage(spark):
    rows = [
        (1, "openai", '{"prompt_tokens":3,"prompt_tokens_details":{"cached_tokens":2}}'),
        (2, "openai", '{"prompt_tokens":2,"prompt_tokens_details":{"cached_tokens":5}}'),
        (3, "anthropic", '{"input_tokens":3,"output_tokens":5}'),
        (4, "anthropic", '{"cache_read_input_tokens":5}'),
        (5, "openai", '{"completion_tokens":-1,"total_tokens":4.5}'),
        (6, "openai", '{"completion_tokens":7}'),
    ]
    df = usage.normalize_usage(spark.createDataFrame(rows, "id int, provider string, usage string"))
    got = {r.id: r.usage for r in df.collect()}
    assert set(got) == {1, 2, 3, 6}
    assert got[1].input_tokens == 1 and got[2].input_tokens == 0
    assert got[3].total_tokens == 8 and got[6].input_tokens is None


def test_merge_usage_keeps_the_newest_known_value(spark):
    rows = [("r", 1, "anthropic", '{"input_tokens":4,"output_tokens":1}'), ("r", 2, "anthropic", '{"output_tokens":6}')]
    df = usage.normalize_usage(spark.createDataFrame(rows, "id string, seq int, provider string, usage string"))
    row = usage.merge_usage_events(df, "id", "seq").first().usage
    # The first total stays: the later event has no input to add.
    assert (row.input_tokens, row.output_tokens, row.total_tokens) == (4, 6, 5)


def costs(spark, rows):
    """(seq, session, turn, at, read, input, usd)"""
    data = [
        (2, "openai", "m", at, s, t, (i, 0, None, read, None), usd, None, None, seq)
        for seq, s, t, at, read, i, usd in rows
    ]
    return spark.createDataFrame(data, T.StructType([*schemas.COST.fields, T.StructField("seq", T.LongType())]))


def test_billing(spark):
    prices = pricing_dim(
        spark,
        {
            "openai": {"input_per_million_usd": 2.0, "output_per_million_usd": 4.0, "cache_read_per_million_usd": 1.0},
            "anthropic": {
                "input_per_million_usd": 3.0, "output_per_million_usd": 15.0,
                "cache_read_per_million_usd": 0.3, "cache_write_per_million_usd": 3.75,
            },
        },
    )
    rows = [("openai", (60, 10, None, 40, None)), ("anthropic", (100, 0, None, 40, 10)), ("local", (1, 1, None, None, None))]
    df = spark.createDataFrame(rows, "provider string, usage struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint,cache_read_tokens:bigint,cache_creation_tokens:bigint>")
    got = {r.provider: r.observed_billing_usd for r in usage.bill_usage(df, prices).collect()}
    assert got["openai"] == approx(0.0002) and got["anthropic"] == approx(349.5e-6) and got["local"] is None


def test_transcript_cost_counts_what_it_leaves_out(spark):
    turns = spark.createDataFrame([("s", []), ("s", [])], "session_id string, lint array<struct<rule:string,heuristic:boolean>>")
    df = costs(spark, [(1, "s", 1, 0, None, 1, 0.01), (2, "s", 2, 0, None, 1, 0.02), (3, "other", 1, 0, None, 1, 5.0), (4, None, None, 0, None, 1, 7.0)])
    row = usage.transcript_cost_report(turns, df).first()
    assert row.cost_usd == approx(0.03) and row.cost_records_excluded == 2 and row.turns == 2


def test_cache_health(spark):
    rows = [(1, "s", 1, 0, 50, 50, 0.01), (2, "s", 2, 0, 0, 100, 0.02), (3, "t", 1, 0, 0, 100, 0.03), (4, "t", 2, 0, None, 100, 9.0)]
    for span in (1, 2, 1000):
        row = usage.cache_health(costs(spark, rows), span=span).first()
        assert (row.observed_records, row.cache_read_records, row.cache_miss_records) == (3, 1, 2)
        assert row.cache_read_to_miss_sessions == 1
        assert row.cache_read_rate == approx(1 / 6) and row.cache_read_rate_trend == approx(-0.5)
        assert row.cache_miss_observed_billing_usd == approx(0.05)


def test_cache_trend_is_the_same_for_every_block_size(spark):
    rng = random.Random(2)
    rows = [(i, f"s{i % 5}", 1, 0, rng.choice([None, 0, 10, 30]), rng.randrange(1, 50), 0.01) for i in range(200)]
    seen = [(r[4], r[4] + r[5]) for r in rows if r[4] is not None]
    half = len(seen) // 2

    def rate(part):
        return sum(r for r, _ in part) / sum(c for _, c in part)

    rng.shuffle(rows)
    for span in (7, 64, 1 << 20):
        assert usage.cache_health(costs(spark, rows), span=span).first().cache_read_rate_trend == approx(rate(seen[half:]) - rate(seen[:half]))


def test_cache_health_of_nothing(spark):
    row = usage.cache_health(costs(spark, [(1, "s", 1, 0, None, 5, 0.1)])).first()
    assert row.observed_records == 0 and row.cache_read_rate is None and row.cache_read_rate_trend is None


def test_cost_burn(spark):
    now = 10_000
    rows = [
        (1, "a", 1, now - 10, None, 1, 0.01), (2, "a", 2, now - 5, None, 1, 0.02), (3, "b", 1, now, None, 1, 0.01),
        (4, "c", 1, now - 3600, None, 1, 0.10), (5, "stale", 1, now - 3601, None, 1, 9.0), (6, "future", 1, now + 1, None, 1, 9.0),
        (7, "legacy", 1, None, None, 1, 9.0), (8, "b", 2, now, None, 1, None),
    ]
    row = usage.cost_burn(costs(spark, rows), now).first()
    assert row.active_cost_sessions == 3 and row.session_median_observed_billing_usd == approx(0.03)
    assert row.sessions_above_three_x_median == 1
    assert row.next_turn_estimated_billing_usd == approx(0.12)
    assert row.projected_billing_after_next_turn_usd == approx(0.26)


def test_cost_burn_of_nothing(spark):
    row = usage.cost_burn(costs(spark, [(1, "a", 1, 5, None, 1, 0.5)]), 100_000).first()
    assert row.active_cost_sessions == 0 and row.next_turn_estimated_billing_usd is None


def test_turn_costs_skip_what_is_not_a_price(spark):
    rows = [(1, "s", 1, 0, None, 1, 0.5), (2, "s", 1, 0, None, 1, -1.0), (3, "s", 1, 0, None, 1, float("nan")), (4, "s", None, 0, None, 1, 1.0), (5, "s", 1, 0, None, 1, None)]
    row = usage.turn_costs(costs(spark, rows)).first()
    assert (row.cost_records, row.priced_cost_records, row.observed_billing_usd) == (4, 1, 0.5)
    assert usage.session_costs(costs(spark, rows[:2])).first().observed_billing_usd == 0.5


def test_transform_gate(spark):
    schema = "request_id int, pos int, message_bytes int, bytes_before int, bytes_after int, changed boolean"
    rows = [(1, 0, 3, None, None, None), (1, 1, 4, 4_000_000, 2_800_000, True), (2, 0, 4, 4_000_000, 3_000_000, True), (3, 0, 8, 5, 5, False)]
    messages = spark.createDataFrame(rows, schema)
    prices = pricing_dim(spark, {"openai": {"input_per_million_usd": 2.0, "output_per_million_usd": 4.0}})
    setting = "min_samples bigint, samples bigint, cache_hit_rate double, cache_break_cost_per_token_usd double"
    ready = spark.createDataFrame([(20, 20, 0.5, 1.0)], setting)
    got = {r.request_id: r for r in usage.transform_gate(messages, prices, ready).collect()}
    # One token (4 bytes div 4) is invalidated: a gain must exceed 0.5 dollars.
    assert got[1].savings_usd == approx(0.6) and got[1].verdict == "allowed" and got[1].invalidated_tokens == 1
    assert got[2].savings_usd == approx(0.5) and got[2].verdict == "denied"
    assert got[3].invalidated_tokens == 0 and got[3].verdict == "denied"
    cold = spark.createDataFrame([(20, 19, 0.5, 1.0)], setting)
    assert {r.verdict for r in usage.transform_gate(messages, prices, cold).collect()} == {"uncalibrated"}
    assert usage.transform_gate(messages, prices.where("false"), ready).where("savings_usd <> 0").count() == 0
