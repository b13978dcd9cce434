"""Continuous forms of the ledger reports: windows, watermarks and partial aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlytics.operators.health import format_counters
from convlytics.operators.usage import session_price
from convlytics.plans.ordered import lower_median
from convlytics.plans.storage import fresh_path

COUNTERS = ["text_responses", "zero_sigil_responses", "table_runs", "malformed_table_runs"]


def _priced(costs: DataFrame, window: str, slide: str, delay: str) -> DataFrame:
    """Priced turns with ``w``, the slide in which the newest of their windows starts.

    A turn lies in many sliding windows; the state holds it once and keeps its slide until the last
    of them has ended.
    """
    if pd.Timedelta(window) % pd.Timedelta(slide):
        raise ValueError("a window must be a whole number of slides")
    priced = costs.where("session_id IS NOT NULL AND observed_billing_usd IS NOT NULL")
    return priced.withWatermark("event_time", f"{delay} {window} -{slide}").withColumn("w", F.window("event_time", slide))


def cost_burn_stream(costs: DataFrame, window: str = "1 hour", slide: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Per session and slide: priced turns and dollars, for ``sliding``.  ``costs`` has ``event_time``."""
    return (
        _priced(costs, window, slide, delay)
        .groupBy("w", "session_id")
        .agg(
            F.count(F.lit(1)).alias("priced_turns"),
            F.sum(session_price().cast("decimal(38,12)")).alias("observed_billing_usd"),
            F.max("event_time").alias("latest"),
        )
        .select(F.col("w.start").alias("window_start"), "session_id", "priced_turns", "observed_billing_usd", "latest")
    )


def price_histogram_stream(costs: DataFrame, window: str = "1 hour", slide: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Per session and slide, how often each price occurred: state that merges and has all medians."""
    return (
        _priced(costs, window, slide, delay)
        .groupBy("w", "session_id", session_price().alias("price"))
        .agg(F.count(F.lit(1)).alias("turns"), F.max("event_time").alias("latest"))
        .select(F.col("w.start").alias("window_start"), "session_id", "price", "turns", "latest")
    )


def added_rows(batches: DataFrame, keys: list[str], sums: list[str], delay: str = "10 minutes") -> DataFrame:
    """What each stored batch added to the slides of an update-mode stream, and the watermark it was judged by.

    A late turn counts in those of its windows that were open: they end after ``mark``.  Spark judges
    late rows by the watermark of the batch before, which knows the times of the batches before that.
    """
    known = Window.orderBy("batch").rangeBetween(Window.unboundedPreceding, -2)
    mark = F.max("__latest").over(known) - F.expr(f"INTERVAL {delay}")
    marks = batches.groupBy("batch").agg(F.max("latest").alias("__latest")).select("batch", mark.alias("mark"))
    version = Window.partitionBy(*keys).orderBy("batch")
    added = {name: F.col(name) - F.coalesce(F.lag(name).over(version), F.lit(0)) for name in sums}
    return batches.select(*keys, "batch", *[c.alias(n) for n, c in added.items()]).join(marks, "batch").drop("batch")


def in_windows(rows: DataFrame, window: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """The rows of the slides, once for each sliding window that they are part of.

    The slides are moved, not their windows: a slide goes to the blocks, one window long, of its
    session in which its windows start.  The result stays dealt by ``session_id`` and ``block``.
    """
    size, step = (pd.Timedelta(t).value // 1000 for t in (window, slide))
    at = rows.withColumn("__at", F.unix_micros("window_start"))
    home = F.col("__at") - F.pmod("__at", F.lit(size))
    near = at.withColumn("block", F.explode(F.array(home, home - size)))
    first = F.greatest(F.col("__at") - size + step, F.col("block"))
    last = F.least(F.col("__at"), F.col("block") + size - step)
    dealt = near.where(first <= last).drop("window_start").repartition("session_id", "block")
    every = dealt.withColumn("__start", F.explode(F.sequence(first, last, F.lit(step))))
    if "mark" in rows.columns:
        every = every.where(F.col("mark").isNull() | (F.col("__start") + size > F.unix_micros("mark")))
    return every.withColumn("window_start", F.timestamp_micros("__start")).drop("__at", "__start")


def sliding(rows: DataFrame, keys: list[str], sums: list[str], window: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """Sums of each sliding window, by ``window_start`` and ``keys``, from those of the slides."""
    by = ["window_start", *keys]
    summed = in_windows(rows, window, slide).groupBy("block", *by).agg(*[F.sum(name).alias(name) for name in sums])
    return summed.select(*by, *sums)


def burn_of_windows(histogram: DataFrame, window: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """Per sliding window what `cost_burn` says at its end, from the slides of the price histogram.

    Sessions and their lower medians, sessions above three times the median total, the spend of one
    more turn each and the projection.
    """
    by, session = ["window_start"], ["block", "window_start", "session_id"]
    exact = F.col("price").cast("decimal(20,12)") * F.col("turns").cast("decimal(10,0)")
    prices = in_windows(histogram.withColumn("spent", exact), window, slide)
    # The windows of a session lie together already, and each is short.
    ascending = Window.partitionBy(*session).orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    ranked = prices.withColumns({"upto": F.sum("turns").over(ascending), "n": F.sum("turns").over(Window.partitionBy(*session))})
    middle = (F.col("upto") >= F.expr("(n + 1) div 2")) & (F.col("upto") - F.col("turns") < F.expr("(n + 1) div 2"))
    totals = ranked.groupBy(*session).agg(
        F.sum("spent").cast("double").alias("total"), F.max(F.when(middle, F.col("price"))).alias("median")
    )
    path = fresh_path(histogram.sparkSession, "window-totals")  # read three times
    totals.drop("block").write.parquet(path)
    totals = histogram.sparkSession.read.parquet(path)
    overall = lower_median(totals, by, "total", "overall")
    above = (F.col("overall") > 0) & (F.col("total").cast("decimal(38,12)") > F.col("overall").cast("decimal(38,12)") * 3)
    return totals.join(overall, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("active_cost_sessions"),
        F.max("overall").alias("session_median_observed_billing_usd"),
        F.count_if(above).alias("sessions_above_three_x_median"),
        F.sum("median").alias("next_turn_estimated_billing_usd"),
        (F.sum("total") + F.sum("median")).alias("projected_billing_after_next_turn_usd"),
    )


def health_stream(responses: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Format counters per window, provider and model.  ``responses`` has ``event_time``."""
    counted = format_counters(responses.withWatermark("event_time", delay))
    return (
        counted.groupBy(F.window("event_time", window).alias("w"), "provider", "model")
        .agg(*[F.sum(c).alias(c) for c in COUNTERS])
        .select(F.col("w.start").alias("window_start"), "provider", "model", *COUNTERS)
    )


def session_stream(requests: DataFrame, ttl: str = "3600 seconds", delay: str = "10 minutes") -> DataFrame:
    """Requests that share their first message, cut where the gap exceeds ``ttl``."""
    key = F.sha2(F.col("first_message").cast("binary"), 256)
    return (
        requests.withWatermark("event_time", delay)
        .withColumn("conversation", key)
        .groupBy(F.session_window("event_time", ttl).alias("w"), "conversation")
        .agg(F.count(F.lit(1)).alias("requests"), F.min("seq").alias("first_seq"))
        .select(F.col("w.start").alias("started"), "conversation", "requests", "first_seq")
    )


def unique_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop replayed tool events that arrive within the delay."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(
        ["session_id", "event_key"]
    )


def latest_rows(batches: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each row of an update-mode stream stored batch by batch."""
    newest = batches.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return batches.join(newest, [*keys, "batch"], "left_semi").drop("batch")

