"""Transcript rows from raw turns: redacted text, lint findings and receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlytics.operators.content import redact
from convlytics.operators.lint import lint_findings
from convlytics.operators.signals import SCHEMA_VERSION, receipt, with_receipts
from convlytics.plans.once import evaluate_once
from convlytics.sources.schemas import FINDING, RECEIPT

TRANSCRIPT_VERSION = 2
_THRASH = [
    "score", "exact_repeated_tool_results", "expensive_exact_repeated_tool_results",
    "wire_cheap_exact_repeated_tool_results", "near_repeated_tool_calls", "edit_fail_edit_cycles",
]


def build_transcript(
    turns: DataFrame, arms: DataFrame | None = None, thrash: DataFrame | None = None
) -> DataFrame:
    """One transcript row per turn.

    ``turns``: ``session_id, seq, session_turn, role, content, conversation_start``.
    Assistant turns are linted on their raw text and carry their terminal, after the
    repetition of their request if there was any; user turns carry readiness and, on the
    session's attempt turn, its arm.  The stored text is redacted.
    """
    none = F.array().cast(T.ArrayType(FINDING))
    marked = with_receipts(turns, arms)
    if thrash is not None:
        found = thrash.select(
            "session_id",
            "session_turn",
            F.array(
                receipt(
                    signal=F.lit("thrash"),
                    schema_version=F.lit(SCHEMA_VERSION),
                    **{c: F.col(c) for c in _THRASH},
                )
            ).alias("__thrash"),
        )
        attached = F.when(
            (F.col("role") == "assistant") & F.col("__thrash").isNotNull(),
            F.concat("__thrash", "receipts"),
        ).otherwise(F.col("receipts"))
        joined = marked.join(found, ["session_id", "session_turn"], "left")
        marked = joined.withColumn("receipts", attached.cast(T.ArrayType(RECEIPT))).drop("__thrash")
    linted = evaluate_once(
        marked,
        {"lint": F.when(F.col("role") == "assistant", lint_findings(F.col("content"))).otherwise(none)},
    )
    clean = redact(linted, "content", "redacted")
    return clean.withColumn("content", F.col("redacted")).drop("redacted").withColumn(
        "schema_version", F.lit(TRANSCRIPT_VERSION)
    )
