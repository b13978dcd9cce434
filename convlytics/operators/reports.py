"""Reports over turns, costs and outcome labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlytics.functions.stats import held_out, pearson
from convlytics.operators.signals import SLOTS, VARIANTS, blocked_cause, terminal_state
from convlytics.operators.usage import session_costs, turn_costs
from convlytics.plans.once import attach_row, evaluate_once
from convlytics.plans.ordered import Nearest, carry, number_rows, running_sum

# How much evidence a conclusion needs.
MIN_LABELLED_HELD_OUT = 8
MIN_ELIGIBLE_PER_ARM = 8
CORRELATION = 0.30


def _with_outcome(df: DataFrame, costs: DataFrame, labels: DataFrame) -> DataFrame:
    """Left-join the session's billed dollars and its label."""
    billed = session_costs(costs)
    outcome = labels.select("session_id", "completed", "correct", F.lit(True).alias("labelled"))
    joined = df.join(billed, "session_id", "left").join(outcome, "session_id", "left")
    return joined.withColumns(
        {
            "observed_billing_usd": F.coalesce("observed_billing_usd", F.lit(0.0)),
            "cost_records": F.coalesce("cost_records", F.lit(0)),
            "labelled": F.coalesce("labelled", F.lit(False)),
        }
    )


# -------------------------------------------------------------------------- readiness

def readiness_observations(turns: DataFrame, costs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per readiness receipt of each session's first conversation-start turn."""
    usable = F.filter(
        "receipts", lambda r: (r["signal"] == "readiness") & F.coalesce(r["conversation_start"], F.lit(False))
    )
    scored = turns.withColumn(
        "__r",
        F.when(
            (F.col("role") == "user") & (F.size(usable) > 0),
            F.transform(usable, lambda r: F.struct(r["variant"].alias("variant"), r["score"].alias("score"))),
        ),
    )
    sessions = scored.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.min_by("__r", F.when(F.col("__r").isNotNull(), F.col("seq"))).alias("__r"),
    )
    rows = sessions.select("session_id", "turns", F.inline("__r"))
    return _with_outcome(rows, costs, labels).drop("cost_records")


def readiness_buckets(observations: DataFrame) -> DataFrame:
    return observations.groupBy("variant", "score").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("observed_billing_usd").alias("observed_billing_usd"),
        F.count_if("labelled").alias("labelled_sessions"),
        F.count_if("completed").alias("completed_sessions"),
        F.count_if("correct").alias("correct_sessions"),
    )


def unlabelled_sessions(observations: DataFrame) -> DataFrame:
    return observations.where("NOT labelled").agg(
        F.count_distinct("session_id").alias("unlabelled_sessions")
    )


def held_out_variants(observations: DataFrame) -> DataFrame:
    """Per variant, on the held-out fifth of the sessions; both variants are present."""
    held = observations.where(held_out(F.col("session_id")))
    full = F.col("completed").isNotNull() & F.col("correct").isNotNull()
    done = full & F.col("completed")
    score = F.col("score").cast("double")
    stats = held.groupBy("variant").agg(
        F.count(F.lit(1)).alias("held_out_sessions"),
        F.count_if(full).alias("labelled_sessions"),
        F.count_if(done).alias("completed_sessions"),
        F.count_if(full & F.col("correct")).alias("correct_sessions"),
        F.sum("observed_billing_usd").alias("observed_billing_usd"),
        pearson(F.when(full, score), F.col("correct").cast("double")).alias(
            "score_correctness_correlation"
        ),
        pearson(F.when(done, score), F.col("observed_billing_usd")).alias("score_cost_correlation"),
        F.avg("turns").alias("diagnostic_mean_turns"),
    )
    both = observations.sparkSession.createDataFrame([(v,) for v in VARIANTS], "variant string")
    joined = both.join(stats, "variant", "left")
    counts = ["held_out_sessions", "labelled_sessions", "completed_sessions", "correct_sessions"]
    return joined.select(
        "variant",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("observed_billing_usd", F.lit(0.0)).alias("observed_billing_usd"),
        (F.col("observed_billing_usd") / F.nullif(F.col("completed_sessions"), F.lit(0))).alias(
            "billed_dollars_per_completed_task"
        ),
        "score_correctness_correlation",
        "score_cost_correlation",
        F.coalesce("diagnostic_mean_turns", F.lit(0.0)).alias("diagnostic_mean_turns"),
    )


def held_out_analysis(observations: DataFrame) -> DataFrame:
    """The split and its conclusion, as one row."""
    held = held_out(F.col("session_id"))
    full = F.col("completed").isNotNull() & F.col("correct").isNotNull()
    split = observations.groupBy("session_id").agg(F.bool_or(full).alias("full"))
    sizes = split.agg(
        F.count_if(~held).alias("training_sessions"),
        F.count_if(held).alias("held_out_sessions"),
        F.count_if(held & F.col("full")).alias("labelled_held_out_sessions"),
    )
    correct, cost = F.col("score_correctness_correlation"), F.col("score_cost_correlation")
    passes = (correct >= CORRELATION) & (cost <= -CORRELATION)
    # The larger gap wins; on a tie the later variant does.
    ranked = F.struct((correct - cost).alias("gap"), F.col("variant").alias("variant"))
    best = held_out_variants(observations).agg(F.max(F.when(passes, ranked)).alias("best"))
    decision = (
        F.when(F.col("labelled_held_out_sessions") < MIN_LABELLED_HELD_OUT, "stop_insufficient_evidence")
        .when(F.col("best").isNull(), "stop_no_predictive_variant")
        .otherwise(F.concat(F.lit("select_"), F.col("best.variant")))
    )
    return attach_row(sizes, best).select(
        "training_sessions", "held_out_sessions", "labelled_held_out_sessions", decision.alias("decision")
    )


# ------------------------------------------------------------------------- experiment

def _session_arms(turns: DataFrame) -> DataFrame:
    arms = F.transform(F.filter("receipts", lambda r: r["signal"] == "advisory"), lambda r: r["arm"])
    return (
        turns.select("session_id", F.array_min(arms).alias("low"), F.array_max(arms).alias("high"))
        .groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("turns"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        .where("low IS NOT NULL")
    )


def experiment_report(turns: DataFrame, costs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per arm; sessions seen in both arms are excluded for good."""
    arms = _session_arms(turns).where("low = high").withColumnRenamed("low", "arm").drop("high")
    joined = _with_outcome(arms, costs, labels)
    eligible = F.col("labelled") & (F.col("cost_records") > 0)
    stats = joined.groupBy("arm").agg(
        F.count(F.lit(1)).alias("assigned_sessions"),
        F.count_if(eligible).alias("eligible_sessions"),
        F.count_if(eligible & F.col("completed")).alias("completed_sessions"),
        F.count_if(eligible & F.col("correct")).alias("correct_sessions"),
        F.sum(F.when(eligible, F.col("observed_billing_usd"))).alias("observed_billing_usd"),
        F.avg(F.when(eligible, F.col("turns"))).alias("diagnostic_mean_turns"),
    )
    both = turns.sparkSession.createDataFrame([("record_only",), ("inject",)], "arm string")
    counts = ["assigned_sessions", "eligible_sessions", "completed_sessions", "correct_sessions"]
    return both.join(stats, "arm", "left").select(
        "arm",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("observed_billing_usd", F.lit(0.0)).alias("observed_billing_usd"),
        (F.col("observed_billing_usd") / F.nullif(F.col("completed_sessions"), F.lit(0))).alias(
            "billed_dollars_per_completed_task"
        ),
        F.coalesce("diagnostic_mean_turns", F.lit(0.0)).alias("diagnostic_mean_turns"),
    )


def experiment_decision(turns: DataFrame, costs: DataFrame, labels: DataFrame) -> DataFrame:
    """Excluded sessions and whether both arms hold enough evidence, as one row."""
    sessions = _with_outcome(_session_arms(turns), costs, labels)
    usable = (F.col("low") == F.col("high")) & F.col("labelled") & (F.col("cost_records") > 0)
    counts = sessions.agg(
        F.count_if(~usable).alias("excluded_sessions"),
        F.count_if(usable & (F.col("low") == "inject")).alias("inject"),
        F.count_if(usable & (F.col("low") == "record_only")).alias("record_only"),
    )
    enough = F.least("inject", "record_only") >= MIN_ELIGIBLE_PER_ARM
    return counts.select(
        "excluded_sessions",
        F.when(enough, "review_required").otherwise("stop_insufficient_evidence").alias("decision"),
    )


# --------------------------------------------------------------------- clarifications

def slot_delta(before: Column, after: Column) -> tuple[Column, Column]:
    """Slots that went from missing to present, and whether the unknowns were resolved."""
    filled = F.array_compact(
        F.array(
            *[
                F.when((before[s] == "missing") & (after[s] == "present"), F.lit(s))
                for s in SLOTS
            ]
        )
    )
    resolved = (before["unresolved_unknowns"] == "unresolved") & (
        after["unresolved_unknowns"] == "not_applicable"
    )
    return filled, resolved


def _question_pairs(turns: DataFrame) -> DataFrame:
    """Each decision turn with the user turn at or before it and the next one after it."""

    def scored(variant: str) -> Column:
        first = F.get(
            F.filter("receipts", lambda r: (r["signal"] == "readiness") & (r["variant"] == variant)),
            F.lit(0),
        )
        return F.when(
            (F.col("role") == "user") & first.isNotNull(),
            F.struct(first["score"].alias("score"), first["slots"].alias("slots")),
        )

    asks = (F.col("role") == "assistant") & F.exists(
        "receipts", lambda r: (r["signal"] == "terminal") & (r["state"] == "decision")
    )
    staged = turns.where("session_turn IS NOT NULL").select(
        "session_id",
        "session_turn",
        "seq",
        (F.col("role") == "user").alias("__user"),
        asks.alias("__asks"),
        *[scored(v).alias(f"__{v}") for v in VARIANTS],
    )
    by_turn = staged.groupBy("session_id", "session_turn").agg(
        F.bool_or("__user").alias("is_user"),
        F.bool_or("__asks").alias("is_question"),
        *[
            F.min_by(f"__{v}", F.when(F.col(f"__{v}").isNotNull(), F.col("seq"))).alias(v)
            for v in VARIANTS
        ],
    )
    user = F.when(
        F.col("is_user"), F.struct(F.col("session_turn").alias("turn"), *[F.col(v) for v in VARIANTS])
    )
    placed = carry(
        by_turn,
        ["session_id"],
        "session_turn",
        {"before": Nearest(user), "after": Nearest(user, inclusive=False, forward=True)},
    )
    return placed.where("is_question").select("session_id", "session_turn", "before", "after")


def _replies(turns: DataFrame, costs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every question twice, once per variant, with what could be measured of its reply."""
    sides = F.array(
        *[
            F.struct(
                F.lit(v).alias("variant"),
                F.col(f"before.{v}").alias("before_slots"),
                F.col(f"after.{v}").alias("after_slots"),
            )
            for v in VARIANTS
        ]
    )
    rows = _question_pairs(turns).select(
        "session_id",
        F.col("session_turn").alias("question_turn"),
        F.col("after.turn").alias("reply_turn"),
        F.col("before").isNotNull().alias("has_before"),
        F.inline(sides),
    )
    spent = turn_costs(costs).select(
        "session_id",
        F.col("session_turn").alias("reply_turn"),
        F.when(F.col("priced_cost_records") > 0, F.col("observed_billing_usd")).alias(
            "reply_turn_observed_billing_usd"
        ),
        F.col("cost_records").alias("reply_turn_cost_records"),
        F.col("priced_cost_records").alias("reply_turn_priced_cost_records"),
    )
    outcome = labels.select("session_id", "completed", "correct")
    measured = F.col("before_slots").isNotNull() & F.col("after_slots").isNotNull()
    return (
        rows.join(spent, ["session_id", "reply_turn"], "left")
        .join(outcome, "session_id", "left")
        .withColumn("measured", measured)
        .withColumn("before_score", F.col("before_slots.score"))
        .withColumn("after_score", F.col("after_slots.score"))
        .withColumn("score_delta", F.col("after_score") - F.col("before_score"))
    )


def clarifications(turns: DataFrame, costs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per decision turn and variant: what the user's reply filled in, and its cost."""
    filled, resolved = slot_delta(F.col("before_slots.slots"), F.col("after_slots.slots"))
    records = ["reply_turn_cost_records", "reply_turn_priced_cost_records"]
    return _replies(turns, costs, labels).where("measured").select(
        "session_id",
        "question_turn",
        "reply_turn",
        "variant",
        "before_score",
        "after_score",
        "score_delta",
        filled.alias("filled_slots"),
        resolved.alias("resolved_unresolved_unknowns"),
        "reply_turn_observed_billing_usd",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in records],
        "completed",
        "correct",
    )


def clarification_summary(turns: DataFrame, costs: DataFrame, labels: DataFrame) -> DataFrame:
    """Questions that could not be measured, and two correlations, as one row."""
    once = F.col("variant") == VARIANTS[0]
    answered = F.col("reply_turn").isNotNull()
    gap = F.when(F.col("has_before"), ~F.col("measured")).otherwise(once)
    delta = F.when(F.col("measured"), F.col("score_delta").cast("double"))
    legacy = turns.agg(F.count_if(F.col("session_turn").isNull()).alias("legacy_records_excluded"))
    facts = _replies(turns, costs, labels).agg(
        F.count_if(once & ~answered).alias("unpaired_decision_turns"),
        F.count_if(answered & gap).alias("incomplete_readiness_pairs"),
        F.count_if("measured").alias("observations"),
        pearson(delta, F.col("reply_turn_observed_billing_usd")).alias(
            "score_delta_reply_turn_cost_correlation"
        ),
        pearson(delta, F.col("correct").cast("double")).alias("score_delta_correctness_correlation"),
    )
    return attach_row(facts, legacy)


# ----------------------------------------------------------------------- trajectories

def terminal_sequence(turns: DataFrame) -> DataFrame:
    """The ordered terminals of each session, one row per assistant turn."""
    spoken = terminal_state(turns.where("role = 'assistant'")).select("session_id", "seq", "state")
    return number_rows(spoken, ["session_id"], "seq", "position")


def terminal_trajectories(turns: DataFrame, costs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per session: terminal counts and the three signs of stuck work.

    Runs of decisions are numbered by a running count of the other terminals, which is
    carried across blocks, so a very long session is spread over many tasks.
    """
    spoken = terminal_state(turns.where("role = 'assistant'"))
    cause = F.when(F.col("state") == "blocked", blocked_cause(F.col("content")))
    spoken = evaluate_once(spoken, {"cause": cause}).select("session_id", "seq", "state", "cause")
    runs = running_sum(
        spoken.drop("cause"),
        ["session_id"],
        "seq",
        {"run": (F.col("state") != "decision").cast("bigint")},
    )
    # Counting per (session, run, state) first keeps the per-session step small.
    by_run = runs.groupBy("session_id", "run").agg(
        F.count(F.lit(1)).alias("assistant_turns"),
        *[
            F.count_if(F.col("state") == s).alias(f"{s}_turns")
            for s in ("done", "decision", "blocked", "missing")
        ],
    )
    kinds = ["assistant_turns", "done_turns", "decision_turns", "blocked_turns", "missing_turns"]
    states = by_run.groupBy("session_id").agg(
        *[F.sum(k).alias(k) for k in kinds],
        F.max("decision_turns").alias("__longest"),
    )
    repeated = (
        spoken.where("cause IS NOT NULL")
        .groupBy("session_id", "cause")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("session_id")
        .agg((F.max("n") > 1).alias("repeated_blocked_cause"))
    )
    sessions = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    joined = sessions.join(states, "session_id", "left").join(repeated, "session_id", "left")
    rows = joined.select(
        "session_id",
        "turns",
        *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds],
        F.coalesce(F.col("__longest") >= 3, F.lit(False)).alias("decision_ping_pong"),
        F.coalesce("repeated_blocked_cause", F.lit(False)).alias("repeated_blocked_cause"),
        F.coalesce(
            (F.col("assistant_turns") >= 5) & (F.col("done_turns") == 0), F.lit(False)
        ).alias("long_run_without_done"),
    )
    return _with_outcome(rows, costs, labels).drop("cost_records")


# ----------------------------------------------------------------------------- thrash

THRASH_FIELDS = [
    "score",
    "exact_repeated_tool_results",
    "expensive_exact_repeated_tool_results",
    "wire_cheap_exact_repeated_tool_results",
    "near_repeated_tool_calls",
    "edit_fail_edit_cycles",
]


def thrash_report(turns: DataFrame, costs: DataFrame) -> DataFrame:
    """Per session: sums of its thrash receipts (zero rows stay) and its cost."""

    def total(field: str) -> Column:
        found = F.filter("receipts", lambda r: r["signal"] == "thrash")
        return F.aggregate(
            found,
            F.lit(0).cast("bigint"),
            lambda acc, r: acc + F.coalesce(r[field].cast("bigint"), F.lit(0)),
        )

    sums = (
        turns.select("session_id", *[total(f).alias(f) for f in THRASH_FIELDS])
        .groupBy("session_id")
        .agg(*[F.sum(f).alias(f) for f in THRASH_FIELDS])
    )
    billed = session_costs(costs).drop("cost_records")
    return sums.join(billed, "session_id", "left").withColumn(
        "observed_billing_usd", F.coalesce("observed_billing_usd", F.lit(0.0))
    )
