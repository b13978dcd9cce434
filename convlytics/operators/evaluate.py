"""Analysis of paired evaluation runs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlytics.functions import text as tx
from convlytics.plans.once import evaluate_once
from convlytics.plans.ordered import Nearest, carry, running_sum
from convlytics.plans.packaging import ship_package

MIN_RUNS_FOR_INTERVAL = 5


#: Relative rank error of the sketch that brackets a percentile, and how many errors wide it is.
_SKETCH, _MARGIN = 10_000, 3


def percentile_linear(df: DataFrame, by: list[str], value: str, probability: float, out: str) -> DataFrame:
    """Exact percentile with linear interpolation.

    A mergeable sketch brackets the rank; only the values inside the bracket, a few
    ten-thousandths of a group, are put in order, so no task holds the values of a group.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    ends = [max(0.0, probability - _MARGIN / _SKETCH), min(1.0, probability + _MARGIN / _SKETCH)]
    box = known.groupBy(*by).agg(F.percentile_approx("__v", ends, _SKETCH).alias("__box"), F.count(F.lit(1)).alias("__all"))
    placed = known.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n")).join(box, by)
    low, high = F.get("__box", F.lit(0)), F.get("__box", F.lit(1))
    # In a small group a neighbour may be the last value before the bracket or the first behind it.
    below = placed.groupBy(*by).agg(
        F.sum(F.when(F.col("__v") < low, F.col("__n")).otherwise(0)).alias("__below"), F.min(F.when(F.col("__v") > high, F.col("__v"))).alias("__next"),
        F.max(F.when(F.col("__v") < low, F.col("__v"))).alias("__last"),
    )
    inside = placed.where(F.col("__v").between(low, high)).join(below, by)
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__v")) + F.col("__below")
    place = F.lit(probability) * (F.col("__all") - 1)
    ranked = inside.withColumns({"__upto": upto, "__at": F.floor(place), "__part": place - F.floor(place)})
    found = ranked.groupBy(*by).agg(
        F.min(F.when(F.col("__at") < F.col("__below"), F.col("__last")).when(F.col("__upto") > F.col("__at"), F.col("__v"))).alias("__a"),
        F.min(F.when(F.col("__upto") > F.col("__at") + 1, F.col("__v"))).alias("__b"),
        F.max("__part").alias("__part"),
        F.max("__next").alias("__next"),
    )
    return found.select(*by, (F.col("__a") + (F.coalesce("__b", "__next", "__a") - F.col("__a")) * F.col("__part")).alias(out))


def paired_summary(observations: DataFrame, by: list[str] | None = None, interval: bool = False) -> DataFrame:
    """Per arm: runs, median tokens and total estimated dollars (NULL when none is priced).

    With ``interval`` also ``low`` and ``high``, the bootstrap interval of the median; this
    takes one grouping column.
    """
    by = by or ["arm"]
    totals = observations.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("estimated_cost").alias("total_estimated_cost"),
    )
    medians = percentile_linear(observations, by, "tokens", 0.5, "median_tokens")
    summary = totals.join(medians, by, "left")
    if not interval:
        return summary
    (arm,) = by
    return summary.join(bootstrap_median_ci(observations, arm).select(arm, "low", "high"), by, "left")


def _draw_middle_ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranks of the two middle order statistics of one resample of ``n`` items.

    The k-th smallest of n uniform draws follows Beta(k, n - k + 1); scaled by n it is
    the rank that a resample with replacement puts in position k.
    """
    for batch in batches:
        ranks = []
        for n, rep, seed, group in zip(batch["n"], batch["rep"], batch["seed"], batch["grp"]):
            rng = np.random.default_rng([seed, zlib.crc32(group.encode()), rep])
            k = (n + 1) // 2
            low = rng.beta(k, n - k + 1)
            high = low
            if n % 2 == 0:
                high = low + (1.0 - low) * (1.0 - (1.0 - rng.random()) ** (1.0 / (n - k)))
            ranks.append((min(int(low * n), n - 1), min(int(high * n), n - 1)))
        yield pd.DataFrame(
            {
                "grp": batch["grp"],
                "rep": batch["rep"],
                "low": [r[0] for r in ranks],
                "high": [r[1] for r in ranks],
            }
        )


def bootstrap_median_ci(
    observations: DataFrame, by: str = "arm", value: str = "tokens", reps: int = 1000, seed: int = 0
) -> DataFrame:
    """Median and its bootstrap 95 % interval per group; no interval below five values.

    Each resampled median is drawn directly from its distribution over ranks, so the
    work is ``reps`` rows per group and one pass over the counted values, whatever the
    number of observations.
    """
    ship_package(observations.sparkSession)
    known = observations.where(F.col(value).isNotNull()).withColumn(by, F.col(by).cast("string"))
    counted = known.groupBy(F.col(by).alias("grp"), F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    upto = running_sum(counted, ["grp"], "value", {"upto": F.col("n")})
    sizes = counted.groupBy("grp").agg(F.sum("n").alias("n"))
    draws = (
        sizes.where(F.col("n") >= MIN_RUNS_FOR_INTERVAL)
        .select(
            "grp", "n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"), F.lit(seed).alias("seed")
        )
        .mapInPandas(_draw_middle_ranks, "grp string, rep int, low bigint, high bigint")
        .select("grp", "rep", F.explode(F.array("low", "high")).alias("rank"))
    )
    # A rank belongs to the first value whose cumulative count exceeds it.
    points = upto.select(
        "grp", (F.col("upto") * 2 - 1).alias("at"), F.col("value").cast("double").alias("value"),
        F.lit(None).cast("int").alias("rep"),
    ).unionByName(
        draws.select(
            "grp", (F.col("rank") * 2).alias("at"), F.lit(None).cast("double").alias("value"), "rep"
        )
    )
    looked_up = carry(points, ["grp"], "at", {"found": Nearest(F.col("value"), forward=True)})
    medians = (
        looked_up.where("rep IS NOT NULL").groupBy("grp", "rep").agg(F.avg("found").alias("median"))
    )
    interval = medians.groupBy("grp").agg(
        F.percentile("median", F.lit(0.025)).alias("low"), F.percentile("median", F.lit(0.975)).alias("high")
    )
    center = percentile_linear(known.withColumnRenamed(by, "grp"), ["grp"], value, 0.5, "median")
    return center.join(interval, "grp", "left").select(
        F.col("grp").alias(by), "low", "median", "high"
    )


def term_coverage(responses: DataFrame, cases: DataFrame) -> DataFrame:
    """Per response: required terms found, the quality floor and structure lines."""
    found = tx.let(
        F.lower("content"),
        lambda low: F.size(F.filter("required_terms", lambda t: low.contains(F.lower(t)))),
    )
    structure = r"(?md)^[ \t\r\f\x0b]*+(?:[§!>~]|-#?[ \t\r\f\x0b]|[0-9]++[.)][ \t\r\f\x0b])"
    joined = responses.join(cases.select("case_id", "required_terms"), "case_id")
    facts = evaluate_once(
        joined,
        {
            "required_found": found,
            "structure_lines": F.regexp_count("content", F.lit(structure)),
        },
    )
    return facts.select(
        *responses.columns,
        F.size("required_terms").alias("required_terms"),
        "required_found",
        "structure_lines",
        (F.col("required_found") == F.size("required_terms")).alias("quality_floor_passed"),
    )


def coverage_summary(covered: DataFrame) -> DataFrame:
    return covered.groupBy("case_id", "arm").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("estimated_billing_usd").alias("estimated_billing_usd"),
        F.count_if("quality_floor_passed").alias("passed"),
        F.sum("structure_lines").alias("structure_lines"),
    )


def budget_cutoff(observations: DataFrame, cap: float, by: list[str] | None = None) -> DataFrame:
    """Add the running estimated dollars and whether the cap is exceeded."""
    spent = running_sum(
        observations, by or [], "seq", {"running_usd": F.col("estimated_billing_usd")}
    )
    return spent.withColumn("over_cap", F.col("running_usd") > cap)


def cutoff_summary(flagged: DataFrame, by: list[str]) -> DataFrame:
    """Where the budget ran out: the first row over the cap and what fitted before it."""
    return flagged.groupBy(*by).agg(
        F.min(F.when(F.col("over_cap"), F.col("seq"))).alias("cutoff_seq"),
        F.count_if(~F.col("over_cap")).alias("runs_within_cap"),
        F.max(F.when(~F.col("over_cap"), F.col("running_usd"))).alias("spent_within_cap"),
    )

