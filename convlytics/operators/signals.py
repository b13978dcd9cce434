"""Readiness, terminal state, experiment arms and the transcript built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlytics.functions import text as tx
from convlytics.operators.content import content_class
from convlytics.plans.once import evaluate_once
from convlytics.sources.schemas import RECEIPT

SCHEMA_VERSION = 1

# The phrases that fill each readiness slot.
TASK_PHRASES = ["?", "please ", "can you ", "could you ", "i need ", "i want "]
TASK_OPENINGS = ["fix ", "add ", "implement ", "update ", "remove ", "refactor ", "explain "]
TARGET_PHRASES = [
    "file", "repo", "component", "module", "function", "endpoint", "api", "codebase", "test", "/",
    ".rs", ".ts", ".py",
]
SUCCESS_PHRASES = ["acceptance", "done", "expected", "should ", "must ", "pass", "verify", "working"]
CONSTRAINT_PHRASES = [
    "do not", "don't", "must not", "only ", "without", "avoid", "preserve", "compatible",
    "compatibility", "keep ",
]
DEBUG_PHRASES = ["bug", "error", "fail", "crash", "regression", "reproduce", "stack trace"]
EVIDENCE_PHRASES = [
    "error:", "stack trace", "reproduce", "version", " macos", " linux", " windows",
]
UNKNOWN_PHRASES = ["not sure", "unknown", "unclear", "don't know", "unsure"]

# Slot names, in report order, and the reason code of each gap.
SLOTS = [
    "task", "target_artifact", "success_criterion", "constraints", "environment_reproduction",
]
MISSING_REASONS = [
    "no_task", "no_target_artifact", "no_success_criterion", "no_constraints",
    "no_environment_reproduction",
]
VARIANTS = ["raw_composite", "trailing_prose"]


def _present(hit: Column) -> Column:
    return F.when(hit, "present").otherwise("missing")


def slots(content: Column) -> Column:
    """The six readiness slots of a text."""

    def of(low: Column) -> Column:
        task = tx.contains_any(low, TASK_PHRASES) | tx.starts_with_any(low, TASK_OPENINGS)
        evidence = tx.contains_any(low, EVIDENCE_PHRASES) | low.rlike("[0-9]")
        environment = F.when(tx.contains_any(low, DEBUG_PHRASES), _present(evidence)).otherwise(
            "not_applicable"
        )
        unknowns = F.when(tx.contains_any(low, UNKNOWN_PHRASES), "unresolved").otherwise(
            "not_applicable"
        )
        return F.struct(
            _present(task).alias("task"),
            _present(tx.contains_any(low, TARGET_PHRASES)).alias("target_artifact"),
            _present(tx.contains_any(low, SUCCESS_PHRASES)).alias("success_criterion"),
            _present(tx.contains_any(low, CONSTRAINT_PHRASES)).alias("constraints"),
            environment.alias("environment_reproduction"),
            unknowns.alias("unresolved_unknowns"),
        )

    return tx.let(tx.ascii_lower(content), of)


def score(filled: Column) -> Column:
    """Share of applicable slots that are present, in whole percent."""
    present = applicable = F.lit(0)
    for slot in SLOTS:
        present = present + (filled[slot] == "present").cast("int")
        applicable = applicable + (filled[slot] != "not_applicable").cast("int")
    return F.floor(present * 100 / applicable).cast("int")


def reasons(filled: Column, fallback: Column) -> Column:
    codes = [
        F.when(filled[slot] == "missing", code) for slot, code in zip(SLOTS, MISSING_REASONS)
    ]
    codes.append(F.when(filled["unresolved_unknowns"] == "unresolved", "unresolved_unknowns"))
    codes.append(F.when(fallback, "trailing_prose_fallback"))
    return F.array_compact(F.array(*codes))


def last_prose_block(content: Column) -> Column:
    """The last blank-line-separated block that is prose; NULL when there is none."""
    blocks = F.transform(F.split(content, "\n\n"), tx.trim)
    prose = F.filter(blocks, lambda b: (b != "") & (content_class(b) == "text"))
    return F.try_element_at(prose, F.lit(-1))


def trailing_prose(turns: DataFrame) -> DataFrame:
    """Add ``prose`` (all content as a fallback) and whether the fallback was used."""
    found = evaluate_once(turns, {"__p": last_prose_block(F.col("content"))})
    return found.select(
        *turns.columns,
        F.coalesce("__p", "content").alias("prose"),
        F.col("__p").isNull().alias("fallback"),
    )


def readiness(turns: DataFrame) -> DataFrame:
    """Two readiness rows per user turn: the raw text and its trailing prose."""
    users = trailing_prose(turns.where("role = 'user'"))
    both = users.select(
        *turns.columns,
        F.explode(
            F.array(
                F.struct(
                    F.lit(VARIANTS[0]).alias("variant"),
                    slots(F.col("content")).alias("slots"),
                    F.lit(False).alias("fallback"),
                ),
                F.struct(
                    F.lit(VARIANTS[1]).alias("variant"),
                    slots(F.col("prose")).alias("slots"),
                    F.col("fallback").alias("fallback"),
                ),
            )
        ).alias("__r"),
    )
    return both.select(
        *turns.columns,
        F.col("__r.variant").alias("variant"),
        score(F.col("__r.slots")).alias("score"),
        F.col("__r.slots").alias("slots"),
        reasons(F.col("__r.slots"), F.col("__r.fallback")).alias("reasons"),
    )


def terminal_of(content: Column) -> Column:
    """done / decision / blocked / missing, from the last visible line."""

    def of(line: Column) -> Column:
        return (
            F.when(tx.has_marker_line(line, "."), "done")
            .when(tx.has_marker_line(line, "?"), "decision")
            .when(tx.has_marker_line(line, "x"), "blocked")
            .otherwise("missing")
        )

    return tx.let(tx.last_nonblank_line(content), of)


def terminal_state(turns: DataFrame) -> DataFrame:
    """Add ``state`` per turn; a stored terminal receipt takes precedence."""
    state = terminal_of(F.col("content"))
    if "receipts" in turns.columns:
        stored = F.filter("receipts", lambda r: r["signal"] == "terminal")
        state = F.coalesce(F.get(stored, F.lit(0))["state"], state)
    return evaluate_once(turns, {"state": state})


def blocked_cause(content: Column) -> Column:
    """Normalised body of a final blocked line, for exact comparison; NULL when empty."""

    def of(line: Column) -> Column:
        body = F.substring(line, 2, F.length(line))
        kept = F.filter(
            F.split(tx.ascii_lower(body), rf"[{tx.WS}]+"), lambda w: F.octet_length(w) > 2
        )
        return F.when(tx.has_marker_line(line, "x"), F.nullif(F.array_join(kept, " "), F.lit("")))

    return tx.let(tx.last_nonblank_line(content), of)


def receipt(**fields: Column) -> Column:
    """One receipt struct; fields that do not apply stay NULL."""
    return F.struct(
        *[
            fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RECEIPT.fields
        ]
    )


def readiness_receipts(content: Column, conversation_start: Column) -> Column:
    def of(variant: str, text: Column, fallback: Column) -> Column:
        return tx.let(
            slots(text),
            lambda s: receipt(
                signal=F.lit("readiness"),
                schema_version=F.lit(SCHEMA_VERSION),
                variant=F.lit(variant),
                conversation_start=conversation_start,
                score=score(s),
                slots=s,
                reasons=reasons(s, fallback),
            ),
        )

    return tx.let(
        last_prose_block(content),
        lambda p: F.array(
            of(VARIANTS[0], content, F.lit(False)),
            of(VARIANTS[1], F.coalesce(p, content), p.isNull()),
        ),
    )


def terminal_receipts(content: Column) -> Column:
    return F.array(
        receipt(
            signal=F.lit("terminal"),
            schema_version=F.lit(SCHEMA_VERSION),
            state=terminal_of(content),
        )
    )


def advisory_receipts() -> Column:
    """The advisory receipt of an attempt turn, from the columns of ``assign_arms``."""
    return F.array(
        receipt(
            signal=F.lit("advisory"),
            schema_version=F.lit(SCHEMA_VERSION),
            variant=F.col("variant"),
            arm=F.col("arm"),
            template_version=F.col("template_version"),
            injected=F.col("injected"),
        )
    )


def with_receipts(turns: DataFrame, arms: DataFrame | None = None) -> DataFrame:
    """Attach readiness receipts to user turns and terminal receipts to assistant turns.

    Turns need a boolean ``conversation_start``.  With ``arms``, the attempt turn of each
    session also gets its advisory receipt.
    """
    none = F.array().cast(T.ArrayType(RECEIPT))
    attached = (
        F.when(
            F.col("role") == "user",
            readiness_receipts(F.col("content"), F.col("conversation_start")),
        )
        .when(F.col("role") == "assistant", terminal_receipts(F.col("content")))
        .otherwise(none)
    )
    if arms is None:
        return evaluate_once(turns, {"receipts": attached})
    marked = turns.join(arms, ["session_id", "seq"], "left")
    advisory = F.when(F.col("arm").isNotNull(), advisory_receipts()).otherwise(none)
    both = evaluate_once(marked, {"receipts": F.concat(attached, advisory)})
    return both.select(*turns.columns, "receipts")


def injects(session_id: Column) -> Column:
    """The stable arm: an even code of the first hex digit of the session's hash."""
    return F.ascii(F.substring(F.sha2(session_id.cast("binary"), 256), 1, 1)) % 2 == 0


#: Fixed value: the version of the advisory template that may be injected.
INJECTED_TEMPLATE = 1


def assign_arms(
    turns: DataFrame,
    selected_variant: str | None,
    randomized: bool = True,
    injection_enabled: bool = True,
    template_version: int = INJECTED_TEMPLATE,
    evidence_id: str | None = None,
) -> DataFrame:
    """One advisory attempt per session, on its first conversation-start user turn.

    Text is injected only for template version 1 and with the id of the evidence that allows
    it; otherwise every attempt is recorded only.
    """
    if selected_variant is None:
        return turns.sparkSession.createDataFrame(
            [],
            "session_id string, seq bigint, arm string, variant string, template_version int, injected boolean",
        )
    starts = (
        turns.where("role = 'user' AND conversation_start")
        .groupBy("session_id")
        .agg(F.min("seq").alias("seq"))
    )
    allowed = randomized and injection_enabled and template_version == INJECTED_TEMPLATE and bool((evidence_id or "").strip())
    assigned = injects(F.col("session_id")) & F.lit(allowed)
    return starts.select(
        "session_id",
        "seq",
        F.when(assigned, "inject").otherwise("record_only").alias("arm"),
        F.lit(selected_variant).alias("variant"),
        F.lit(template_version).alias("template_version"),
        assigned.alias("injected"),
    )
