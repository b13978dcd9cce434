"""Inputs of the registered queries, derived by Spark from the given tables.

The raw conversations hold no markers, usage or tool calls; these views add them by a
rule, over every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlytics.plans.ordered import running_sum
from convlytics.plans.storage import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_table(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A text table, spread by its unique id when it arrives in fewer pieces than cores."""
    return spread(table(spark, sf, name), key)


TURN_CONTENT = r"""
CASE WHEN role = 'user' THEN CASE (conv_id * 3 + turn) % 5
       WHEN 0 THEN 'Fix the bug in src/lib.rs. Done when tests pass. ' || text
       WHEN 1 THEN 'please explain this error: not sure why. ' || text
       WHEN 2 THEN text || chr(10) || chr(10) || 'Do not change the API. Preserve compatibility.'
       WHEN 3 THEN 'token=abc' || CAST(conv_id AS STRING) || ' ' || text
       ELSE text END
     WHEN conv_id % 10 = 3 THEN text || chr(10) || '? need scope; options: a, b'
     WHEN conv_id % 10 = 4 THEN text || chr(10) || 'x dependency unavailable'
     ELSE text || CASE (conv_id * 7 + turn * 3) % 6
       WHEN 0 THEN chr(10) || '. done'
       WHEN 1 THEN chr(10) || '? need scope; options: a, b'
       WHEN 2 THEN chr(10) || 'x dependency unavailable'
       WHEN 3 THEN chr(10) || '|Name|Count' || chr(10) || '|one|2' || chr(10) || '. shipped'
       WHEN 4 THEN chr(10) || '|Name|Count' || chr(10) || '|one' || chr(10) || '. shipped'
       ELSE '' END
END
"""

PROVIDER = (
    "CASE WHEN conv_id % 10 < 4 THEN 'openai' WHEN conv_id % 10 < 9 THEN 'anthropic' ELSE 'local' END"
)
SKILL_VERSION = (
    "CASE WHEN conv_id % 7 = 0 THEN NULL WHEN conv_id % 14 < 7 THEN '1.0.1' ELSE '1.1.0' END"
)


def fx_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with marker lines, in append order, without receipts."""
    rows = table(spark, sf, "conversations").where("role IN ('user', 'assistant')")
    rows = running_sum(
        rows, ["conv_id"], "turn", {"session_turn": F.expr("CAST(role = 'user' AS BIGINT)")}
    )
    return rows.selectExpr(
        "CAST(conv_id AS STRING) AS session_id",
        "conv_id * 1000 + turn AS seq",
        "session_turn",
        "role",
        f"{TURN_CONTENT} AS content",
        f"{PROVIDER} AS provider",
        "'m0' AS model",
        f"{SKILL_VERSION} AS skill_version",
    )


def fx_messages(spark: SparkSession, sf: str) -> DataFrame:
    """As ``fx_turns`` but without turn numbers, for work that needs no order."""
    return fx_every_message(spark, sf).where("role IN ('user', 'assistant')")


def fx_every_message(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of all roles."""
    return spread(table(spark, sf, "conversations"), "conv_id", "turn").selectExpr(
        "CAST(conv_id AS STRING) AS session_id",
        "conv_id * 1000 + turn AS seq",
        "role",
        f"{TURN_CONTENT} AS content",
        f"{PROVIDER} AS provider",
        "'m0' AS model",
        f"{SKILL_VERSION} AS skill_version",
    )


def fx_turns_long(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of conversations as one session, so that longer runs occur."""
    return fx_messages(spark, sf).selectExpr(
        "CAST(CAST(FLOOR(seq / 2000.0) AS BIGINT) AS STRING) AS session_id", "seq", "role", "content"
    )


def fx_costs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id AS seq",
        "CAST(user_id AS STRING) AS session_id",
        "1 + event_id % 4 AS session_turn",
        "CASE WHEN user_id % 3 = 0 THEN 'openai' WHEN user_id % 3 = 1 THEN 'anthropic' ELSE 'local' END"
        " AS provider",
        "'m' || CAST(user_id % 2 AS STRING) AS model",
        "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS recorded_at_secs",
        "named_struct('input_tokens', 100 + event_id % 900, 'output_tokens', 10 + event_id % 90,"
        " 'total_tokens', 110 + event_id % 900 + event_id % 90,"
        " 'cache_read_tokens', CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN 0"
        " ELSE (event_id % 5) * 20 END,"
        " 'cache_creation_tokens', CASE WHEN event_id % 3 = 0 THEN event_id % 50 END) AS usage",
        "CASE WHEN event_type = 'click' THEN NULL ELSE"
        " CAST((100 + event_id % 900) * 3 + (10 + event_id % 90) * 15 AS DOUBLE) / 1000000.0 END"
        " AS observed_billing_usd",
        "CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 100 AS DOUBLE) / 1000.0 END"
        " AS estimated_savings_usd",
    )


def fx_labels(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "conversations")
        .where("conv_id % 11 <> 0")
        .selectExpr(
            "CAST(conv_id AS STRING) AS session_id",
            "CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 3 <> 0 END AS completed",
            "CASE WHEN conv_id % 7 = 0 THEN NULL ELSE conv_id % 4 <> 1 END AS correct",
        )
        .distinct()
    )


def fx_tool_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id AS seq",
        "CAST(user_id AS STRING) AS session_id",
        "1 + event_id % 4 AS session_turn",
        "'e' || CAST(event_id AS STRING) AS event_key",
        "CASE WHEN event_type IN ('error', 'signup') THEN 'result' ELSE 'call' END AS kind",
        "CASE WHEN event_type NOT IN ('error', 'signup') THEN 'c' || CAST(event_id AS STRING) END AS call_key",
        "CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE event_type END AS tool",
        "CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE"
        " split('path src k' || CAST(event_id % 3 AS STRING) || ' v' || CAST(event_id % 2 AS STRING), ' ')"
        " END AS tokens",
        "event_type = 'purchase' AS is_edit",
        "event_type = 'error' AS failed",
        "event_id % 7 = 0 AS wire_cheap",
        "CASE WHEN event_type IN ('error', 'signup') THEN 'r' || CAST(event_id % 50 AS STRING) END AS result_text",
    )


# Each shape holds the whole text of its document.
_ESCAPED = r"""replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"""
_LINE = "replace(text, chr(10), chr(10) || '{}')"


def doc_text(escaped: str) -> str:
    return rf"""
CASE doc_id % 10
  WHEN 0 THEN '{{"b":' || CAST(doc_id AS STRING) || ',"a":[1,2],"text":"' || {escaped} || '"}}'
  WHEN 1 THEN 'INFO start' || chr(10) || 'INFO start' || chr(10) || 'WARN ' || {_LINE.format("WARN ")} || chr(10) || 'INFO end' || chr(10) || 'INFO end'
  WHEN 2 THEN 'fn main() {{' || chr(10) || '    let x = 1;' || chr(10) || '}}; ' || {_LINE.format("return ")}
  WHEN 3 THEN 'diff --git a/x b/x' || chr(10) || '--- a/x' || chr(10) || '+++ b/x' || chr(10) || '@@ -1 +1 @@' || chr(10) || '+' || {_LINE.format("+")}
  WHEN 4 THEN 'a,b,c,d' || chr(10) || '1,2,3,' || {_LINE.format("1,2,3,")} || chr(10) || '1,2,3,' || CAST(doc_id AS STRING)
  WHEN 5 THEN 'src/part.rs:10: ' || {_LINE.format("src/part.rs:12: ")}
  WHEN 6 THEN chr(27) || '[31mred ' || text
  WHEN 7 THEN 'please   fix the  ' || source || ', thank you' || chr(10) || chr(10) || chr(10) || chr(10) || '   now;  ' || text
  ELSE text END
"""


#: Spark's string literals read a backslash as an escape, SQL's own do not.
DOC_TEXT = doc_text(_ESCAPED)
DOC_TEXT_SQL = doc_text(_ESCAPED.replace("\\\\", "\\"))


def fx_docs(spark: SparkSession, sf: str) -> DataFrame:
    return text_table(spark, sf, "documents", "doc_id").selectExpr(
        "doc_id", "source", "lang", f"{DOC_TEXT} AS text"
    )


PROSE_TEXT = r"""
CASE doc_id % 4
  WHEN 0 THEN 'Please   look:  ' || text || ' thanks to ' || source || ', thanks;'
  WHEN 1 THEN text || chr(10) || chr(10) || chr(10) || '  Thank you for this damned  note:, '
  WHEN 2 THEN replace(text, '. ', '.   ') || ' thx'
  ELSE text END
"""


def fx_prose(spark: SparkSession, sf: str) -> DataFrame:
    """The whole documents with filler words, loose spacing and stray line endings."""
    return text_table(spark, sf, "documents", "doc_id").selectExpr(
        "doc_id", "source", f"{PROSE_TEXT} AS text"
    )


def fx_first_messages(spark: SparkSession, sf: str) -> DataFrame:
    """One request per user turn, with the first message of its conversation."""
    raw = table(spark, sf, "conversations")
    first = raw.where("turn = 0").selectExpr(
        "conv_id", "role || chr(10) || text AS first_message"
    )
    return raw.where("role = 'user'").select("conv_id", "turn").join(first, "conv_id").selectExpr(
        "turn * 1000000 + conv_id AS request_id", "conv_id AS expected_session", "turn", "first_message"
    )


# Whole documents with what each document rule looks for, and with each kind of malformed answer.
LINT_TEXT = r"""
CASE doc_id % 6
  WHEN 0 THEN 'Here' || chr(39) || 's the text' || chr(10) || text
  WHEN 1 THEN 'Sure thing' || chr(10) || text
  WHEN 2 THEN text || chr(10) || 'Got it, thanks for that. Great question, sounds good.'
  WHEN 3 THEN text || chr(10) || 'Perhaps it works, maybe not; it might, possibly.'
  WHEN 4 THEN text || chr(10) || 'You must fix this' || chr(10) || '! now'
  ELSE text || chr(10) || '. done' END
"""
PROBE_TEXT = r"""
CASE doc_id % 8
  WHEN 0 THEN text || chr(10) || '. done'
  WHEN 1 THEN '-dash line' || chr(10) || text || chr(10) || '. done'
  WHEN 2 THEN '. early' || chr(10) || text
  WHEN 3 THEN '. one' || chr(10) || text || chr(10) || '. two'
  WHEN 4 THEN text || chr(10) || '|a|b|' || chr(10) || '. done'
  WHEN 5 THEN text || chr(10) || '```'
  WHEN 6 THEN '-x' || chr(10) || '|a|' || chr(10) || '? q' || chr(10) || text
  ELSE text END
"""


def fx_planted(spark: SparkSession, sf: str, planted: str) -> DataFrame:
    return text_table(spark, sf, "documents", "doc_id").selectExpr("doc_id", f"{planted} AS text")


def fx_whole_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Two requests per conversation: its whole history, and the one before without the last turn."""
    raw = table(spark, sf, "conversations")
    last = raw.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    sent = raw.join(last, "conv_id").withColumn("shorter", F.explode(F.array(F.lit(0), F.lit(1))))
    return sent.where("turn <= last_turn - shorter").selectExpr(
        "conv_id * 2 + shorter AS request_id", "conv_id", "turn AS pos", "role", "text"
    )


def fx_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The assistant texts cut into 16-character deltas."""
    turns = fx_messages(spark, sf).where("role = 'assistant' AND length(content) > 0")
    return turns.select(
        F.col("seq").alias("stream_id"),
        "content",
        F.explode(F.expr("sequence(0, (length(content) - 1) div 16)")).alias("i"),
    ).selectExpr(
        "stream_id",
        "i = (length(content) - 1) div 16 AS closed",
        "CAST(i AS BIGINT) AS chunk_seq",
        "substring(content, CAST(1 + 16 * i AS INT), 16) AS delta",
    )


PRICES = [
    ("openai", 2.0, 4.0, 1.0, None),
    ("anthropic", 3.0, 15.0, 0.3, 3.75),
]


def fx_pricing(spark: SparkSession) -> DataFrame:
    from convlytics.sources.schemas import PRICING

    return spark.createDataFrame(PRICES, PRICING)
