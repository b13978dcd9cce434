"""Token usage, billing and cache behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlytics.plans.once import attach_row, evaluate_once
from convlytics.plans.ordered import SPAN, lower_median

USAGE_FIELDS = [
    "input_tokens",
    "output_tokens",
    "total_tokens",
    "cache_read_tokens",
    "cache_creation_tokens",
]

_RAW_USAGE = (
    "prompt_tokens BIGINT, completion_tokens BIGINT, total_tokens BIGINT,"
    " prompt_tokens_details STRUCT<cached_tokens: BIGINT>,"
    " input_tokens BIGINT, output_tokens BIGINT, cache_read_input_tokens BIGINT,"
    " cache_creation_input_tokens BIGINT"
)


def _count(column: Column) -> Column:
    """Token counts are non-negative integers; anything else is unknown."""
    return F.when(column >= 0, column)


def normalize_usage(df: DataFrame, provider_col: str = "provider", usage_col: str = "usage") -> DataFrame:
    """Turn provider usage JSON into one ``usage`` struct; rows without counts are dropped."""
    raw = F.from_json(F.col(usage_col), _RAW_USAGE)
    df = evaluate_once(df, {"__u": raw})
    cached = _count(F.col("__u.prompt_tokens_details.cached_tokens"))
    prompt = _count(F.col("__u.prompt_tokens"))
    direct_in, direct_out = _count(F.col("__u.input_tokens")), _count(F.col("__u.output_tokens"))
    anthropic = F.col(provider_col) == "anthropic"

    def pick(if_anthropic: Column, otherwise: Column) -> Column:
        return F.when(anthropic, if_anthropic).otherwise(otherwise)

    fields = [
        pick(direct_in, F.greatest(prompt - F.coalesce(cached, F.lit(0)), F.lit(0) * prompt)),
        pick(direct_out, _count(F.col("__u.completion_tokens"))),
        pick(direct_in + direct_out, _count(F.col("__u.total_tokens"))),
        pick(_count(F.col("__u.cache_read_input_tokens")), cached),
        pick(_count(F.col("__u.cache_creation_input_tokens")), F.lit(None).cast("bigint")),
    ]
    usage = F.struct(*[f.alias(n) for f, n in zip(fields, USAGE_FIELDS)])
    return (
        df.withColumn("usage", usage)
        .where(F.coalesce("usage.input_tokens", "usage.output_tokens", "usage.total_tokens").isNotNull())
        .drop("__u")
    )


def merge_usage_events(df: DataFrame, key: str, order: str) -> DataFrame:
    """Several usage events per response: the newest known value of each field wins."""
    newest = [
        F.max_by(f"usage.{f}", F.when(F.col(f"usage.{f}").isNotNull(), F.col(order))).alias(f)
        for f in USAGE_FIELDS
    ]
    merged = df.groupBy(key).agg(*newest)
    return merged.select(key, F.struct(*USAGE_FIELDS).alias("usage"))


def bill_usage(costs: DataFrame, pricing: DataFrame) -> DataFrame:
    """Set ``observed_billing_usd`` from token counts; unknown without a price."""
    price = pricing.select(
        F.col("provider").alias("__p"),
        F.col("input_per_million_usd").alias("__in"),
        F.col("output_per_million_usd").alias("__out"),
        F.coalesce("cache_read_per_million_usd", "input_per_million_usd").alias("__read"),
        F.coalesce("cache_write_per_million_usd", "input_per_million_usd").alias("__write"),
    )

    def tokens(field: str) -> Column:
        return F.coalesce(F.col(f"usage.{field}"), F.lit(0))

    dollars = (
        tokens("input_tokens") * F.col("__in")
        + tokens("output_tokens") * F.col("__out")
        + tokens("cache_read_tokens") * F.col("__read")
        + tokens("cache_creation_tokens") * F.col("__write")
    ) / F.lit(1_000_000.0)
    # Few providers, so a shuffle by provider would put a third of the ledger in one task.
    joined = costs.join(price, F.col("provider") == F.col("__p"), "left")
    return joined.withColumn("observed_billing_usd", dollars).drop(
        "__p", "__in", "__out", "__read", "__write"
    )


def usage_totals(costs: DataFrame) -> DataFrame:
    """Ledger totals; the billing sum is clamped after summing."""
    return costs.agg(
        F.count(F.lit(1)).alias("records"),
        F.greatest(F.coalesce(F.sum("observed_billing_usd"), F.lit(0.0)), F.lit(0.0)).alias(
            "observed_billing_usd"
        ),
        F.count("observed_billing_usd").alias("priced_records"),
        F.coalesce(F.sum("estimated_savings_usd"), F.lit(0.0)).alias("estimated_savings_usd"),
        F.count("estimated_savings_usd").alias("savings_records"),
    )


def session_costs(costs: DataFrame) -> DataFrame:
    """Billed dollars per session, each row clamped at zero, with the record count."""
    return (
        costs.where("session_id IS NOT NULL")
        .groupBy("session_id")
        .agg(
            F.sum(F.greatest(F.coalesce("observed_billing_usd", F.lit(0.0)), F.lit(0.0))).alias(
                "observed_billing_usd"
            ),
            F.count(F.lit(1)).alias("cost_records"),
        )
    )


def turn_costs(costs: DataFrame) -> DataFrame:
    """Per (session, turn): records, priced records and their dollars."""
    price = F.col("observed_billing_usd")
    priced = price.isNotNull() & ~F.isnan(price) & (price >= 0) & (price < F.lit(float("inf")))
    return (
        costs.where("session_id IS NOT NULL AND session_turn IS NOT NULL")
        .groupBy("session_id", "session_turn")
        .agg(
            F.count(F.lit(1)).alias("cost_records"),
            F.count_if(priced).alias("priced_cost_records"),
            F.sum(F.when(priced, price).otherwise(0.0)).alias("observed_billing_usd"),
        )
    )


def transcript_cost_report(turns: DataFrame, costs: DataFrame) -> DataFrame:
    """Turns and lint findings, with the cost of the sessions present in the transcript."""
    transcript = turns.agg(
        F.count(F.lit(1)).alias("turns"),
        F.coalesce(F.sum(F.size("lint")), F.lit(0)).cast("bigint").alias("lint_findings"),
        F.coalesce(
            F.sum(F.size(F.filter("lint", lambda f: f["heuristic"]))), F.lit(0)
        ).cast("bigint").alias("heuristic_findings"),
    )
    per_session = costs.groupBy("session_id").agg(
        F.sum("observed_billing_usd").alias("usd"), F.count(F.lit(1)).alias("records")
    )
    present = turns.select("session_id").distinct().withColumn("present", F.lit(True))
    matched = per_session.join(present, "session_id", "left")
    found = F.col("present").isNotNull()
    cost = matched.agg(
        F.greatest(F.coalesce(F.sum(F.when(found, F.col("usd"))), F.lit(0.0)), F.lit(0.0)).alias(
            "cost_usd"
        ),
        F.coalesce(F.sum(F.when(~found, F.col("records"))), F.lit(0)).alias("cost_records_excluded"),
    )
    return attach_row(transcript, cost)


def session_price() -> Column:
    """The price of a row; unknown, negative and non-finite ones are zero."""
    price = F.col("observed_billing_usd")
    ok = price.isNotNull() & ~F.isnan(price) & (price > 0) & (price < F.lit(float("inf")))
    return F.when(ok, price).otherwise(0.0)


def cache_health(costs: DataFrame, span: int = SPAN) -> DataFrame:
    """Cache reads, misses, their rate and its trend, and sessions that lost their cache.

    The trend splits the observed rows at ``n div 2`` in append order.  Blocks of ``seq``
    are summed first; only the block that holds the split is ranked row by row.
    """
    read = F.col("usage.cache_read_tokens")
    observed = costs.where(read.isNotNull()).select(
        "seq",
        "session_id",
        read.alias("read"),
        (F.coalesce("usage.input_tokens", F.lit(0)) + read).alias("cacheable"),
        session_price().alias("price"),
        F.floor(F.col("seq") / F.lit(span)).cast("bigint").alias("block"),
    )
    blocks = observed.groupBy("block").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("read") > 0).alias("reads"),
        F.sum("read").alias("read"),
        F.sum("cacheable").alias("cacheable"),
        F.sum(F.when(F.col("read") <= 0, F.col("price")).otherwise(0.0)).alias("miss_usd"),
    )
    # One row per block of `span` append positions: small enough for one ordered pass.
    ordered = Window.partitionBy(F.lit(1)).orderBy("block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    placed = blocks.select(
        "*",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.expr("sum(n) over (partition by 1) div 2").alias("split"),
        F.sum("n").over(everything).alias("total"),
    )
    early = F.col("n_before") + F.col("n") <= F.col("split")
    cut = (F.col("n_before") < F.col("split")) & (F.col("n_before") + F.col("n") > F.col("split"))
    totals = placed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("observed_records"),
        F.coalesce(F.sum("reads"), F.lit(0)).alias("cache_read_records"),
        F.coalesce(F.sum("read"), F.lit(0)).alias("cache_read_tokens"),
        F.coalesce(F.sum("cacheable"), F.lit(0)).alias("cacheable_input_tokens"),
        F.coalesce(F.sum("miss_usd"), F.lit(0.0)).alias("cache_miss_observed_billing_usd"),
        F.coalesce(F.sum(F.when(early, F.col("read"))), F.lit(0)).alias("early_read"),
        F.coalesce(F.sum(F.when(early, F.col("cacheable"))), F.lit(0)).alias("early_cacheable"),
    )
    split_block = placed.where(cut).select(
        F.col("block").alias("cut_block"), (F.col("split") - F.col("n_before")).alias("take")
    )
    in_cut = (
        observed.join(split_block, F.col("block") == F.col("cut_block"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy("seq")))
        .where("rank <= take")
        .agg(
            F.coalesce(F.sum("read"), F.lit(0)).alias("cut_read"),
            F.coalesce(F.sum("cacheable"), F.lit(0)).alias("cut_cacheable"),
        )
    )
    churn = (
        observed.where("session_id IS NOT NULL")
        .groupBy("session_id")
        .agg(
            F.min(F.when(F.col("read") > 0, F.col("seq"))).alias("first_read"),
            F.max(F.when(F.col("read") <= 0, F.col("seq"))).alias("last_miss"),
        )
        .agg(F.count_if(F.col("first_read") < F.col("last_miss")).alias("cache_read_to_miss_sessions"))
    )
    joined = attach_row(attach_row(totals, in_cut), churn)
    early_read = F.col("early_read") + F.col("cut_read")
    early_all = F.col("early_cacheable") + F.col("cut_cacheable")
    late_rate = (F.col("cache_read_tokens") - early_read) / F.nullif(
        F.col("cacheable_input_tokens") - early_all, F.lit(0)
    )
    trend = late_rate - early_read / F.nullif(early_all, F.lit(0))
    return joined.select(
        "observed_records",
        "cache_read_records",
        (F.col("observed_records") - F.col("cache_read_records")).alias("cache_miss_records"),
        "cache_read_tokens",
        "cacheable_input_tokens",
        (F.col("cache_read_tokens") / F.nullif(F.col("cacheable_input_tokens"), F.lit(0))).alias(
            "cache_read_rate"
        ),
        F.when(F.col("observed_records") >= 2, trend).alias("cache_read_rate_trend"),
        "cache_read_to_miss_sessions",
        "cache_miss_observed_billing_usd",
    )


def cost_burn(costs: DataFrame, now: Column | int, window: int = 3600) -> DataFrame:
    """Active sessions' spend and an estimate after one more turn of each.

    ``now`` is an epoch second, or a column of ``costs`` that holds it.
    """
    now = now if isinstance(now, Column) else F.lit(now)
    at = F.col("recorded_at_secs")
    active = costs.where(
        F.col("session_id").isNotNull()
        & F.col("observed_billing_usd").isNotNull()
        & (at <= now)
        & (now - at <= window)
    ).select("session_id", session_price().alias("price"))
    # Decimal sums do not depend on the order of the rows, so the comparison is stable.
    exact = F.col("price").cast("decimal(38,12)")
    totals = active.groupBy("session_id").agg(F.sum(exact).cast("double").alias("total"))
    medians = lower_median(active, ["session_id"], "price", "median")
    overall = lower_median(totals, [], "total", "overall")
    next_turn = medians.agg(F.sum("median").alias("next_turn"))
    spent = attach_row(totals, overall).agg(
        F.count(F.lit(1)).alias("active_cost_sessions"),
        F.max("overall").alias("session_median_observed_billing_usd"),
        F.count_if(
            (F.col("overall") > 0)
            & (F.col("total").cast("decimal(38,12)") > F.col("overall").cast("decimal(38,12)") * 3)
        ).alias("sessions_above_three_x_median"),
        F.sum("total").alias("spent"),
    )
    return attach_row(spent, next_turn).select(
        "active_cost_sessions",
        "session_median_observed_billing_usd",
        "sessions_above_three_x_median",
        F.col("next_turn").alias("next_turn_estimated_billing_usd"),
        (F.col("spent") + F.col("next_turn")).alias("projected_billing_after_next_turn_usd"),
    )


def transform_gate(
    messages: DataFrame,
    pricing: DataFrame,
    calibration: DataFrame,
    provider: str = "openai",
) -> DataFrame:
    """Would the savings of normalising a request exceed the cache it invalidates?

    ``messages`` has one row per message of a request: ``request_id, pos, message_bytes,
    bytes_before, bytes_after, changed``; the last three describe user messages only.
    """
    saved = F.greatest(F.col("bytes_before") - F.col("bytes_after"), F.lit(0))
    # The suffix from the first changed message is a difference of two sums over the
    # request, so the messages are grouped once and never ordered.
    keyed = messages.groupBy("request_id").agg(
        F.coalesce(F.sum(saved), F.lit(0)).alias("saved_bytes"),
        F.min(F.when(F.col("changed"), F.col("pos"))).alias("first_changed"),
    )
    suffix = (
        messages.join(keyed.where("first_changed IS NOT NULL"), "request_id")
        .where(F.col("pos") >= F.col("first_changed"))
        .groupBy("request_id")
        .agg(F.sum("message_bytes").alias("suffix_bytes"))
    )
    price = pricing.where(F.col("provider") == provider).select(
        F.col("input_per_million_usd").alias("price")
    )
    price = price.agg(F.first("price").alias("price"))
    settings = calibration.agg(
        F.first("min_samples").alias("min_samples"),
        F.first("samples").alias("samples"),
        F.first("cache_hit_rate").alias("hit_rate"),
        F.first("cache_break_cost_per_token_usd").alias("break_cost"),
    )
    sized = keyed.join(suffix, "request_id", "left")
    joined = (
        attach_row(attach_row(sized, price), settings)
        .withColumn("savings_usd", F.coalesce(F.col("saved_bytes") / 4.0 * F.col("price") / 1_000_000.0, F.lit(0.0)))
        .withColumn("invalidated_tokens", F.expr("coalesce(suffix_bytes, 0) div 4"))
    )
    calibrated = F.coalesce(
        (F.col("samples") >= F.coalesce("min_samples", F.lit(20))) & F.col("hit_rate").between(0.0, 1.0),
        F.lit(False),
    )
    pays = F.col("savings_usd") > F.col("invalidated_tokens") * F.col("hit_rate") * F.col("break_cost")
    return joined.select(
        "request_id",
        "saved_bytes",
        "savings_usd",
        "invalidated_tokens",
        F.when(~calibrated, "uncalibrated").when(pays, "allowed").otherwise("denied").alias("verdict"),
    )
