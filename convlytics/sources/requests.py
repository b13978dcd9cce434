"""Request payloads as tables: messages, blocks, tool events and prompt audits.

``requests`` has ``request_id, provider, payload`` with the payload as JSON text.
Payloads are parsed once into VARIANT; everything else is expressions over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlytics.functions import text as tx
from convlytics.operators.repeats import is_edit_tool
from convlytics.plans.once import evaluate_once

CACHE_SLOTS = 4


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _string(value: Column, path: str) -> Column:
    """The value at ``path`` when it is a JSON string."""
    found = _get(value, path, "variant")
    return F.when(_kind(found) == "STRING", _get(value, path, "string"))


def _array(value: Column, path: str) -> Column:
    return _get(value, path, "array<variant>")


def _is_false(value: Column, path: str) -> Column:
    found = _get(value, path, "variant")
    return F.coalesce(
        (_kind(found) == "BOOLEAN") & ~_get(value, path, "boolean"), F.lit(False)
    )


def parse_requests(requests: DataFrame) -> DataFrame:
    """Add ``body`` (VARIANT); payloads that are not JSON are dropped."""
    return evaluate_once(requests, {"body": F.try_parse_json("payload")}).where("body IS NOT NULL")


def content_text(content: Column) -> Column:
    """A string as it is, or the text blocks of a block list joined by newlines."""
    blocks = _array(content, "$")
    texts = F.array_compact(F.transform(blocks, lambda b: _string(b, "$.text")))
    return F.coalesce(_string(content, "$"), F.array_join(texts, "\n"))


def explode_messages(requests: DataFrame) -> DataFrame:
    """One row per message, in payload order."""
    parsed = parse_requests(requests)
    rows = parsed.select(
        "request_id", "provider", F.posexplode(_array(F.col("body"), "$.messages")).alias("pos", "message")
    )
    return rows.select(
        "request_id",
        "provider",
        "pos",
        _string(F.col("message"), "$.role").alias("role"),
        content_text(_get(F.col("message"), "$.content", "variant")).alias("text"),
        _string(F.col("message"), "$.content").isNotNull().alias("is_plain_text"),
        "message",
    )


def explode_blocks(messages: DataFrame) -> DataFrame:
    """One row per content block of messages that carry a block list."""
    rows = messages.select(
        "request_id",
        "provider",
        "pos",
        "role",
        F.posexplode(_array(F.col("message"), "$.content")).alias("block", "content"),
    )
    return rows.select(
        "*",
        _string(F.col("content"), "$.type").alias("type"),
        _string(F.col("content"), "$.text").alias("text"),
    )


# ------------------------------------------------------------------------ tool events

def opaque_key(*parts: Column) -> Column:
    pieces = []
    for part in parts:
        pieces += [part, F.lit("\0")]
    return F.sha2(F.concat(*pieces).cast("binary"), 256)


def value_tokens(value: Column) -> Column:
    """Keys, lower-cased word pieces, numbers and booleans of a JSON value, at any depth.

    The value is written as canonical JSON and scanned once, so depth does not matter.
    """
    canonical = F.regexp_replace(F.to_json(value), r"\\(?:u[0-9a-fA-F]{4}|.)", " ")
    atoms = F.regexp_extract_all(
        canonical, F.lit(r'"[^"]*+":?+|-?[0-9][0-9.eE+\-]*+|true|false'), F.lit(0)
    )

    def tokens(atom: Column) -> Column:
        inner = F.regexp_extract(atom, r'"([^"]*+)"', 1)
        pieces = F.filter(F.split(tx.ascii_lower(inner), "[^a-z0-9]+"), lambda p: p != "")
        return (
            F.when(atom.endswith('":'), F.array(F.concat(F.lit("key:"), inner)))
            .when(atom.startswith('"'), F.transform(pieces, lambda p: F.concat(F.lit("value:"), p)))
            .when(atom.isin("true", "false"), F.array(F.concat(F.lit("bool:"), atom)))
            .otherwise(F.array(F.concat(F.lit("number:"), atom)))
        )

    return F.coalesce(
        F.flatten(F.transform(atoms, tokens)), F.array().cast("array<string>")
    )


def _call(protocol: Column, pos: Column, index: Column, name: Column, call_id: Column, args: Column) -> Column:
    key = opaque_key(protocol, F.lit("call"), pos.cast("string"), index.cast("string"))
    named = F.concat(F.array(F.concat(F.lit("name:"), name)), value_tokens(args))
    tokens = F.array_sort(F.array_distinct(named))
    return F.struct(
        index.cast("int").alias("index"),
        F.lit("call").alias("kind"),
        key.alias("event_key"),
        opaque_key(protocol, F.lit("call-link"), F.coalesce(call_id, key)).alias("call_key"),
        opaque_key(F.concat(protocol, F.lit("-tool")), name).alias("tool"),
        F.transform(tokens, lambda t: opaque_key(F.lit("tool-token"), t)).alias("tokens"),
        is_edit_tool(name).alias("is_edit"),
        F.lit(None).cast("string").alias("digest"),
        F.lit(False).alias("failed"),
    )


def _result(protocol: Column, pos: Column, index: Column, block: str, call_id: Column, content: Column, failed: Column) -> Column:
    """``block`` is the block index as text, or '' when results are whole messages."""
    body = F.coalesce(_string(content, "$"), F.to_json(content))
    link = F.when(call_id.isNotNull(), opaque_key(protocol, F.lit("call-link"), call_id))
    return F.struct(
        index.cast("int").alias("index"),
        F.lit("result").alias("kind"),
        opaque_key(protocol, F.lit("result"), pos.cast("string"), block).alias("event_key"),
        link.alias("call_key"),
        F.lit(None).cast("string").alias("tool"),
        F.lit(None).cast("array<string>").alias("tokens"),
        F.lit(False).alias("is_edit"),
        F.sha2(body.cast("binary"), 256).alias("digest"),
        failed.alias("failed"),
    )


def _reports_failure(value: Column) -> Column:
    error = _get(value, "$.error", "variant")
    return (
        _is_false(value, "$.success")
        | _is_false(value, "$.ok")
        | F.coalesce(error.isNotNull() & (_kind(error) != "VOID"), F.lit(False))
    )


def _flagged(value: Column) -> Column:
    flag = _get(value, "$.is_error", "variant")
    return F.coalesce((_kind(flag) == "BOOLEAN") & _get(value, "$.is_error", "boolean"), F.lit(False))


def tool_events(requests: DataFrame) -> DataFrame:
    """Tool calls and results of each request, with opaque keys and token sets.

    Results without an id link to the latest call before them in the same payload.
    """
    message, pos = F.col("message"), F.col("pos")
    rows = explode_messages(requests)
    openai, anthropic = F.lit("openai"), F.lit("anthropic")

    calls = F.transform(
        _array(message, "$.tool_calls"),
        lambda c, i: F.when(
            _string(c, "$.function.name").isNotNull(),
            _call(
                openai, pos, i, _string(c, "$.function.name"), _string(c, "$.id"),
                F.try_parse_json(_string(c, "$.function.arguments")),
            ),
        ),
    )
    content = _get(message, "$.content", "variant")
    parsed = F.coalesce(F.try_parse_json(_string(content, "$")), content)
    whole = F.array(
        _result(
            openai, pos, F.lit(0), F.lit(""), _string(message, "$.tool_call_id"), content,
            _flagged(content) | _reports_failure(parsed),
        )
    )
    blocks = F.transform(
        _array(message, "$.content"),
        lambda b, i: F.when(
            (_string(b, "$.type") == "tool_use") & _string(b, "$.name").isNotNull(),
            _call(
                anthropic, pos, i, _string(b, "$.name"), _string(b, "$.id"),
                _get(b, "$.input", "variant"),
            ),
        ).when(
            (_string(b, "$.type") == "tool_result") & _get(b, "$.content", "variant").isNotNull(),
            _result(
                anthropic, pos, i, i.cast("string"), _string(b, "$.tool_use_id"),
                _get(b, "$.content", "variant"), _flagged(b) | _reports_failure(b),
            ),
        ),
    )
    found = (
        F.when(F.col("provider") == "anthropic", blocks)
        .when(F.col("role") == "assistant", calls)
        .when((F.col("role") == "tool") & content.isNotNull(), whole)
    )
    events = rows.select("request_id", "provider", "pos", F.inline(F.array_compact(found)))
    # All rows of one request come from one payload, so this window is as small as a row.
    order = Window.partitionBy("request_id").orderBy("pos", "index")
    latest = F.last(F.when(F.col("kind") == "call", F.col("call_key")), ignorenulls=True).over(order)
    return events.withColumn("call_key", F.coalesce("call_key", latest))


def session_tool_events(requests: DataFrame, stitched: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """The tool events of requests as the repetition operators take them.

    ``stitched``: ``request_id, session_id, session_turn`` of each request.  ``seq`` orders a
    session's events by request, message and block.  ``replaced``: ``session_id, event_key`` of
    results that went out as references; they are marked as cheap.
    """
    events = tool_events(requests).join(stitched.select("request_id", "session_id", "session_turn"), "request_id")
    place = F.shiftleft(F.col("session_turn").cast("bigint"), 40) + F.shiftleft(F.col("pos").cast("bigint"), 16) + F.col("index")
    if replaced is None:
        cheap = F.lit(False)
    else:
        marks = replaced.select("session_id", "event_key").distinct().withColumn("__cheap", F.lit(True))
        events = events.join(marks, ["session_id", "event_key"], "left")
        cheap = F.coalesce("__cheap", F.lit(False)) & (F.col("kind") == "result")
    return events.select(
        "session_id", place.alias("seq"), "session_turn", "event_key", "kind", "call_key", "tool", "tokens", "is_edit", "digest", "failed",
        cheap.alias("wire_cheap"),
    )


# ---------------------------------------------------------------------- prompt audits

def cache_slot_audit(requests: DataFrame) -> DataFrame:
    """Per request: cache breakpoints in use and whether one more could be placed."""
    body = F.col("body")

    def marked(value: Column) -> Column:
        return _get(value, "$.cache_control", "variant").isNotNull()

    def count(blocks: Column) -> Column:
        return F.coalesce(F.size(F.filter(blocks, marked)), F.lit(0))

    messages = _array(body, "$.messages")
    in_messages = F.aggregate(
        messages,
        F.lit(0),
        lambda acc, m: acc + marked(m).cast("int") + count(_array(m, "$.content")),
    )
    used = (
        count(_array(body, "$.system"))
        + count(_array(body, "$.tools"))
        + F.coalesce(in_messages, F.lit(0))
    )
    first = F.get(_array(body, "$.system"), F.lit(0))
    fits = _string(body, "$.system").isNotNull() | F.coalesce(
        (_string(first, "$.type") == "text") & ~marked(first), F.lit(False)
    )
    return parse_requests(requests).select(
        "request_id",
        "provider",
        _string(body, "$.model").alias("model"),
        used.alias("breakpoints"),
        ((used < CACHE_SLOTS) & fits).alias("can_place"),
    )


def cache_slot_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("model").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("breakpoints").alias("breakpoints"),
        F.count_if("can_place").alias("can_place"),
    )


def constraint_coverage(requests: DataFrame, marker: str, constraints: str) -> DataFrame:
    """Per provider: requests whose system position holds the marked constraint text."""
    segment = f"{marker}\n{constraints}"
    body = F.col("body")
    in_messages = F.exists(
        _array(body, "$.messages"),
        lambda m: (_string(m, "$.role") == "system") & (_string(m, "$.content") == segment),
    )
    first = F.get(_array(body, "$.system"), F.lit(0))
    in_system = (_string(first, "$.type") == "text") & (_string(first, "$.text") == segment)
    in_instructions = _string(body, "$.instructions").contains(segment)
    held = (
        F.when(F.col("provider") == "anthropic", in_system)
        .when(F.col("provider") == "responses", in_instructions)
        .when(F.col("provider") == "openai", in_messages)
    )
    checked = parse_requests(requests).select(
        "provider", F.coalesce(held, F.lit(False)).alias("held")
    )
    return checked.groupBy("provider").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("held").alias("covered"),
        F.avg(F.col("held").cast("double")).alias("coverage"),
    )
