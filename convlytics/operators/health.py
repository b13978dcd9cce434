"""Response-format health: marker use, table runs and their trend by version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlytics.functions import text as tx
from convlytics.plans.once import evaluate_once
from convlytics.sources.schemas import HEALTH_COUNTERS

# Comparison thresholds between two versions.
MIN_TEXT_RESPONSES = 40
ZERO_MARKER_DELTA = 0.05
MALFORMED_TABLE_DELTA = 0.02

TABLE_RUN = r"(?smd)^\|.*?(?:\n(?!\|)|\z)"

_MARKER_LINES = (
    rf"(?md)^(?:[§>!~]|-[#>!~]?)(?:[{tx.WS}]|\z)"
)
_FINAL_TERMINAL = (
    rf"(?:\A|\n)[.?x](?:{tx.HSPACE}[^\n]*+)?(?:\n[{tx.WS}]*+)?\z"
)
_EMPHASIS = rf"(?md)(?:^\\?|[{tx.WS}])\*[{tx.ALNUM}]"


def table_is_valid(run: Column) -> Column:
    """Two or more rows, the same number of cells, no closing separator."""

    def of(rows: Column) -> Column:
        cells = F.transform(rows, lambda r: F.length(r) - F.length(F.replace(r, F.lit("|"), F.lit(""))))
        closed = F.exists(rows, lambda r: (F.length(r) > 1) & r.endswith("|"))
        return (F.size(rows) >= 2) & (F.size(F.array_distinct(cells)) == 1) & ~closed

    rows = F.transform(
        F.split(F.regexp_replace(run, r"\n\z", ""), "\n"), lambda r: F.regexp_replace(r, r"\r\z", "")
    )
    return tx.let(rows, of) & ~run.endswith("\r")


def _marked(body: Column, valid_tables: Column) -> Column:
    prose = F.regexp_replace(body, r"(?md)^\|[^\n]*+", "|")
    prose = F.regexp_replace(prose, r"`[^`\n]*+(?:`|(?=\n)|\z)", "`")
    return (
        (valid_tables > 0)
        | body.rlike(_MARKER_LINES)
        | body.rlike(_FINAL_TERMINAL)
        | (body.contains("*") & prose.rlike(_EMPHASIS))
    )


def counters(content: Column) -> Column:
    """Table runs, valid ones, and whether any marker stands outside the code fences."""

    def of_body(body: Column) -> Column:
        def of_runs(runs: Column) -> Column:
            valid = F.size(F.filter(runs, table_is_valid))
            return F.struct(
                F.size(runs).alias("runs"), valid.alias("valid"), _marked(body, valid).alias("marked")
            )

        return tx.let(F.regexp_extract_all(body, F.lit(TABLE_RUN), F.lit(0)), of_runs)

    return tx.let(tx.without_fences(content), of_body)


def uses_markers(content: Column) -> Column:
    """Does the text hold at least one recognised marker outside its code fences?"""
    return counters(content)["marked"]


def format_counters(responses: DataFrame, text_col: str = "content") -> DataFrame:
    """Add the four per-response format counters."""
    present = F.col(text_col) != ""
    return (
        evaluate_once(responses, {"__c": counters(F.col(text_col))})
        .withColumns(
            {
                "text_responses": present.cast("bigint"),
                "zero_sigil_responses": (present & ~F.col("__c.marked")).cast("bigint"),
                "table_runs": F.col("__c.runs").cast("bigint"),
                "malformed_table_runs": (F.col("__c.runs") - F.col("__c.valid")).cast("bigint"),
            }
        )
        .drop("__c")
    )


def model_health(health: DataFrame) -> DataFrame:
    """Counter sums and rates per provider and model; a rate without a base is NULL."""
    sums = health.groupBy("provider", "model").agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in HEALTH_COUNTERS]
    )

    def rate(part: str, whole: str) -> Column:
        return F.col(part) / F.nullif(F.col(whole), F.lit(0))

    return sums.select(
        "*",
        rate("substitution_misses", "substitution_attempts").alias("miss_rate"),
        rate("zero_sigil_responses", "text_responses").alias("zero_sigil_rate"),
        rate("malformed_table_runs", "table_runs").alias("malformed_table_rate"),
    )


def format_health(health: DataFrame) -> DataFrame:
    """Sums per provider, model and version, next to the version seen before it."""
    counters = HEALTH_COUNTERS[2:]
    keys = ["provider", "model", "skill_version"]
    versions = (
        health.where(~tx.is_blank(F.col("skill_version")))
        .groupBy(*keys)
        .agg(
            *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counters],
            F.min("seq").alias("first_seq"),
        )
    )
    # One row per version: the window sees counts of versions, not of responses.
    order = Window.partitionBy("provider", "model").orderBy("first_seq", "skill_version")
    return versions.select(
        *keys,
        *counters,
        "first_seq",
        F.lag("skill_version").over(order).alias("baseline_skill_version"),
        *[F.lag(c).over(order).alias(f"baseline_{c}") for c in counters],
    )


def format_assessment(versions: DataFrame) -> DataFrame:
    """Add the rate changes against the baseline and the advice that follows."""
    zero_delta = F.col("zero_sigil_responses") / F.nullif(F.col("text_responses"), F.lit(0)) - F.col(
        "baseline_zero_sigil_responses"
    ) / F.nullif(F.col("baseline_text_responses"), F.lit(0))
    malformed_delta = F.coalesce(
        F.col("malformed_table_runs") / F.nullif(F.col("table_runs"), F.lit(0))
        - F.col("baseline_malformed_table_runs") / F.nullif(F.col("baseline_table_runs"), F.lit(0)),
        F.lit(0.0),
    )
    few = (F.col("text_responses") < MIN_TEXT_RESPONSES) | (
        F.col("baseline_text_responses") < MIN_TEXT_RESPONSES
    )
    worse = (zero_delta > ZERO_MARKER_DELTA) | (malformed_delta > MALFORMED_TABLE_DELTA)
    compared = F.col("baseline_skill_version").isNotNull()
    return versions.select(
        "*",
        F.when(compared, zero_delta).alias("zero_sigil_delta"),
        F.when(compared, malformed_delta).alias("malformed_table_delta"),
        F.when(~compared, "no_baseline")
        .when(few, "insufficient_samples")
        .when(worse, "rollback_recommended")
        .otherwise("monitoring")
        .alias("assessment"),
    )


# -------------------------------------------------------------- compliance of a probe

_BREAKS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]"
_PROBE_MARKER = (
    rf"(?md)^(?:[§>!~.?x](?:[{tx.WS}]|\z)|-++[#>!~]?(?:[{tx.WS}]|\z)|\\[§>!~.?x\-])"
)
_PROBE_TERMINAL = rf"(?md)^[.?x](?:[{tx.WS}]|\z)"
_PROBE_FINAL = rf"(?:\A|\n)[.?x](?:{tx.HSPACE}[^\n]*+)?(?:\n[{tx.WS}]*+)?\z"


def probe_compliance(responses: DataFrame, text_col: str = "content") -> DataFrame:
    """Per response: marker lines, terminals and the kinds of malformed structure."""
    staged = evaluate_once(responses, {"__t": F.regexp_replace(F.col(text_col), _BREAKS, "\n")})
    staged = evaluate_once(staged, {"__b": tx.without_fences(F.col("__t"))})
    markers = F.regexp_count("__b", F.lit(_PROBE_MARKER))
    terminals = F.regexp_count("__b", F.lit(_PROBE_TERMINAL))
    final = F.col("__b").rlike(_PROBE_FINAL)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("__b").rlike(r"(?md)^-[^\-#>!~ \t\n]"), "ambiguous dash prefix"),
            F.when(
                (F.col("terminal_count") > 0) & ((F.col("terminal_count") != 1) | ~final),
                "terminal is missing, duplicated, or not final",
            ),
            F.when(F.col("__b").rlike(r"(?md)^\|(?:[^\n]*\|)?$"), "trailing table separator"),
            F.when(F.regexp_count("__t", F.lit(r"(?md)^```")) % 2 == 1, "unterminated fence"),
        )
    )
    return (
        staged.withColumn("sigil_line_count", markers)
        .withColumn("terminal_count", terminals)
        .withColumn("malformed_reasons", reasons)
        .withColumn("zero_sigil", F.col("sigil_line_count") == 0)
        .withColumn("malformed", F.size("malformed_reasons") > 0)
        .drop("__t", "__b")
    )


def compliance_rates(probed: DataFrame, by: list[str]) -> DataFrame:
    return probed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("responses"),
        F.avg(F.col("zero_sigil").cast("double")).alias("zero_sigil_rate"),
        F.avg(F.col("malformed").cast("double")).alias("malformed_rate"),
    )
