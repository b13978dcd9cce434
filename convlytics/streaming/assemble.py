"""Assemble response streams: deltas in, settled text and one record per response out.

Input rows: ``stream_id, chunk_seq, event_time, provider, data, closed``; ``data`` is a
piece of the server-sent event text, as bytes or a string, and may cut a record anywhere, also
inside a character.  Chunks may arrive out of order.  ``closed`` marks a clean end.

The keyed state only decides which text is settled.  Rendering it is left to the same
column expressions that the batch form uses.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from convlytics.operators.render import render_segment
from convlytics.operators.usage import USAGE_FIELDS

_RECORD_END = re.compile(rb"\r\n\r\n|\n\n")
_FIELD = re.compile(r"data:|event:|id:|retry:|:")
_TERMINAL = re.compile(r"[.?x](\s|$)")

OUTPUT = T.StructType(
    [
        T.StructField("stream_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("piece", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("verbatim", T.BooleanType()),
        T.StructField("final", T.BooleanType()),
        *[T.StructField(f, T.LongType()) for f in USAGE_FIELDS],
    ]
)


def record_data(record: str) -> str | None:
    """The single ``data:`` value of a record; None when it is malformed or has none."""
    values = []
    for line in record.split("\n"):
        line = line.removesuffix("\r")
        if line and not _FIELD.match(line):
            return None
        if line.startswith("data:"):
            values.append(line[5:].removeprefix(" "))
    return values[0] if len(values) == 1 else None


def _tokens(usage: dict, *names: str) -> int | None:
    for name in names:
        usage = usage.get(name) if isinstance(usage, dict) else None
    return usage if type(usage) is int and usage >= 0 else None


def usage_of(event: dict, provider: str) -> list[int | None] | None:
    """Usage counts of one event, in ``USAGE_FIELDS`` order; None when it has none."""
    if provider == "anthropic" and event.get("type") == "message_start":
        event = event.get("message") or {}
    usage = event.get("usage")
    if not isinstance(usage, dict):
        return None
    if provider == "anthropic":
        tin, tout = _tokens(usage, "input_tokens"), _tokens(usage, "output_tokens")
        total = tin + tout if tin is not None and tout is not None else None
        cached = _tokens(usage, "cache_read_input_tokens")
        counts = [tin, tout, total, cached, _tokens(usage, "cache_creation_input_tokens")]
    else:
        prompt, cached = _tokens(usage, "prompt_tokens"), _tokens(usage, "prompt_tokens_details", "cached_tokens")
        tin = None if prompt is None else max(prompt - (cached or 0), 0)
        counts = [tin, _tokens(usage, "completion_tokens"), _tokens(usage, "total_tokens"), cached, None]
    return counts if any(c is not None for c in counts[:3]) else None


def settle(text: str, fenced: bool, ended: bool) -> tuple[list[tuple[str, bool, bool]], str, bool]:
    """Split off the pieces of ``text`` that no later text can change.

    Returns ``(pieces, rest, fenced)``; a piece is ``(text, verbatim, final)``.  Runs of
    table or dash lines wait for their end, and a terminal line waits until visible text
    or the end of the stream follows it.
    """
    pieces: list[tuple[str, bool, bool]] = []
    while text:
        newline = text.find("\n")
        cut = newline + 1 if newline >= 0 else len(text) if ended else 0
        if not fenced and text[0] in "|-":
            run_end = re.search(r"\n(?!" + re.escape(text[0]) + ")", text)
            cut = run_end.end() if run_end else 0
            if ended and (not cut or cut == len(text)):
                cut = len(text)
            elif cut == len(text):
                cut = 0
        if not cut:
            break
        piece, rest = text[:cut], text[cut:]
        marks_fence = piece.startswith("```")
        final = False
        if not fenced and _TERMINAL.match(piece):
            final = not rest.strip()
            if final and not ended:
                break
        pieces.append((piece, fenced or marks_fence, final))
        fenced = fenced != marks_fence
        text = rest
    return pieces, text, fenced


class Assembler(StatefulProcessor):
    """Keyed state of one response: waiting chunks, unparsed text and open blocks."""

    def __init__(self, timeout_ms: int):
        self._timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # next chunk, unparsed text, done, deadline, pieces, usage counts
        head = "next BIGINT, buffer BINARY, done BOOLEAN, deadline BIGINT, pieces BIGINT, usage ARRAY<BIGINT>"
        self._head = handle.getValueState("head", head)
        chunk = "data BINARY, closed BOOLEAN"
        self._waiting = handle.getMapState("waiting", "chunk_seq BIGINT", chunk)
        block = "original STRING, rest STRING, fenced BOOLEAN"
        self._blocks = handle.getMapState("blocks", "block BIGINT", block)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        head = self._head.get() or (0, b"", False, 0, 0, None)
        following, buffer, done, deadline, pieces, usage = head
        buffer = bytes(buffer)
        usage = list(usage) if usage else [None] * len(USAGE_FIELDS)
        out: list[tuple] = []
        provider, latest = "openai", deadline
        # State is read and written once per call; the work in between is on these.
        arrived: dict[int, tuple[str, bool]] = {}
        opened: dict[int, tuple[str, str, bool]] = {i: s for (i,), s in self._blocks.iterator()}
        late = {i for (i,) in self._waiting.keys()}
        for batch in rows:
            for seq, at, source, data, closed in zip(
                batch["chunk_seq"], batch["event_time"], batch["provider"], batch["data"], batch["closed"]
            ):
                provider = source
                latest = max(latest, int(at.timestamp() * 1000) + self._timeout_ms)
                if seq >= following:
                    arrived[int(seq)] = (data, bool(closed))

        def emit(index: int, found: list) -> None:
            nonlocal pieces
            for text, verbatim, final in found:
                out.append((key[0], "text", index, pieces, text, verbatim, final, *[None] * len(USAGE_FIELDS)))
                pieces += 1

        def flush() -> None:
            for index in sorted(opened):
                original, rest, fenced = opened[index]
                found, rest, fenced = settle(rest, fenced, True)
                emit(index, found)
                opened[index] = (original, rest, fenced)

        def add(index: int, text: str) -> None:
            original, rest, fenced = opened.get(index, ("", "", False))
            found, rest, fenced = settle(rest + text, fenced, False)
            emit(index, found)
            opened[index] = (original + text, rest, fenced)

        def read(event: dict) -> None:
            counts = usage_of(event, provider)
            if counts:
                usage[:] = [new if new is not None else old for new, old in zip(counts, usage)]
            if provider == "anthropic":
                delta = event.get("delta") or {}
                if event.get("type") == "content_block_delta" and delta.get("type") == "text_delta":
                    if isinstance(delta.get("text"), str) and isinstance(event.get("index"), int):
                        add(event["index"], delta["text"])
                return
            choices = event.get("choices")
            if isinstance(choices, list) and len(choices) == 1:
                text = (choices[0].get("delta") or {}).get("content")
                if isinstance(text, str):
                    add(0, text)

        while not done and (following in arrived or following in late):
            if following in arrived:
                data, closed = arrived.pop(following)
            else:
                data, closed = self._waiting.getValue((following,))
                self._waiting.removeKey((following,))
            following += 1
            buffer += bytes(data or b"")
            while (end := _RECORD_END.search(buffer)) is not None:
                value, buffer = record_data(buffer[: end.start()].decode(errors="replace")), buffer[end.end() :]
                if value is None or value == "[DONE]":
                    continue
                try:
                    event = json.loads(value)
                except ValueError:
                    continue
                if isinstance(event, dict):
                    read(event)
            if closed:
                flush()
                whole = "\n".join(opened[index][0] for index in sorted(opened))
                out.append((key[0], "record", None, pieces, whole, None, None, *usage))
                done, buffer = True, b""
        if done:
            self._blocks.clear()
            self._waiting.clear()
        else:
            for seq, chunk in arrived.items():
                self._waiting.updateValue((seq,), chunk)
            for index, block in opened.items():
                self._blocks.updateValue((index,), block)
        if latest != deadline:
            self._handle.registerTimer(latest)
        self._head.update((following, buffer, done, latest, pieces, usage))
        if out:
            yield pd.DataFrame(out, columns=OUTPUT.fieldNames()).astype(
                {c: "Int64" for c in ("block", "piece", *USAGE_FIELDS)}
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A stream that never closed leaves no record, as a broken transport does."""
        head = self._head.get()
        if head and expiredTimerInfo.getExpiryTimeInMs() >= head[3]:
            self._head.clear()
            self._waiting.clear()
            self._blocks.clear()
        return iter([])

    def close(self) -> None:
        pass


def assemble_stream(chunks: DataFrame, delay: str = "10 minutes", timeout_secs: int = 3600) -> DataFrame:
    """Settled pieces (``kind = 'text'``) and finished responses (``kind = 'record'``).

    Start it from ``stateful_session``: the keyed state needs the RocksDB store.
    """
    # The worker that prepares the state store does not see files added to the session,
    # so the processor travels by value.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    keyed = chunks.withColumn("data", F.col("data").cast("binary")).withWatermark("event_time", delay).groupBy("stream_id")
    return keyed.transformWithStateInPandas(
        Assembler(timeout_secs * 1000), OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def render_pieces(assembled: DataFrame) -> DataFrame:
    """Markdown of each settled piece, by the batch rendering expressions."""
    pieces = assembled.where("kind = 'text'")
    return pieces.withColumn(
        "rendered",
        F.when(F.col("verbatim"), F.col("text")).otherwise(
            render_segment(F.col("text"), F.col("final"))
        ),
    )
