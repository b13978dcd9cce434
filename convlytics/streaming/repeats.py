"""Repetition found continuously, with keyed state per session that expires when it idles.

Input rows are tool events with ``event_time``.  A session's state holds what its later events
are compared with: the event keys and result digests it has seen, its edit calls, its last
calls and whether a failed edit waits for the next one.  A micro-batch reads and writes the
state of its own sessions only, in parts of bounded size, so its cost follows its own events.
"""

from __future__ import annotations

import sys
import zlib
from collections import deque
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from convlytics.operators.repeats import PRIOR_CALLS, SIMILARITY
from convlytics.operators.sessions import TTL_SECS

COUNTS = [
    "exact_repeated_tool_results", "expensive_exact_repeated_tool_results", "wire_cheap_exact_repeated_tool_results",
    "near_repeated_tool_calls", "edit_fail_edit_cycles", "score",
]
OUTPUT = T.StructType(
    [T.StructField("session_id", T.StringType()), T.StructField("session_turn", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in COUNTS]
)
_RECEIPT = Row(*OUTPUT.fieldNames())
_EVENT = ["seq", "session_turn", "event_key", "kind", "call_key", "tool", "tokens", "is_edit", "digest", "wire_cheap", "failed", "at"]


_KEY, _DIGEST, _EDIT = "k", "d", "e"
#: Values in a part of a session's set, on average at most.
_PART = 128


def _known(value):
    """None for what pandas has for NULL."""
    return None if value is None or value != value else value


class _Seen:
    """The values that a session has seen, in parts: one is read or written as a whole, once per batch."""

    def __init__(self, state, parts: int = 1, size: int = 0):
        self._state, self.parts, self.size = state, parts, size
        self._read: dict[int, set[str]] = {}
        self._changed: set[int] = set()

    def _part(self, number: int) -> set[str]:
        if number not in self._read:
            held = self._state.getValue((number,))
            self._read[number] = set(held[0]) if held else set()
        return self._read[number]

    def _place(self, name: str) -> int:
        return zlib.crc32(name.encode()) % self.parts

    def add(self, kind: str, value: str | None) -> bool:
        """Whether the value is new."""
        name = f"{kind}-" if value is None else f"{kind}={value}"
        place = self._place(name)
        part = self._part(place)
        if name in part:
            return False
        part.add(name)
        self.size += 1
        self._changed.add(place)
        return True

    def holds(self, kind: str, value: str) -> bool:
        name = f"{kind}={value}"
        return name in self._part(self._place(name))

    def store(self) -> None:
        if self.size > self.parts * _PART:  # so seldom that each value is moved a few times in all
            every = [name for number in range(self.parts) for name in self._part(number)]
            while self.size > self.parts * _PART // 2:
                self.parts *= 2
            self._read = {number: set() for number in range(self.parts)}
            for name in every:
                self._read[self._place(name)].add(name)
            self._changed = set(self._read)
        for number in self._changed:
            self._state.updateValue((number,), (sorted(self._read[number]),))
        self._changed.clear()


class Repeats(StatefulProcessor):
    def __init__(self, ttl_ms: int, prior: int, threshold: float):
        self._ttl_ms, self._prior, self._threshold = ttl_ms, prior, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._head = handle.getValueState(
            "head",
            "latest STRING, pending BOOLEAN, deadline BIGINT, parts INT, size INT,"
            " calls ARRAY<STRUCT<tool: STRING, tokens: ARRAY<STRING>>>",
        )
        self._seen = handle.getMapState("seen", "part INT", "members ARRAY<STRING>")

    def _similar(self, tool: str, tokens: frozenset, calls: deque) -> bool:
        for other, before in calls:
            if other == tool and before != tokens:
                shared = len(before & tokens)
                if shared >= self._threshold * (len(before) + len(tokens) - shared):
                    return True
        return False

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        latest, pending, deadline, parts, size, held = self._head.get() or (None, False, 0, 1, 0, [])
        seen = _Seen(self._seen, parts, size)
        calls = deque(((tool, frozenset(tokens)) for tool, tokens in held), self._prior)
        events, until = [], deadline
        events.extend(tuple(row)[-len(_EVENT):] for row in rows)
        events.sort(key=lambda e: e[0])
        found: dict[int, list[int]] = {}
        for _, turn, event, kind, call, tool, tokens, is_edit, digest, cheap, failed, at in events:
            if until and at > until:  # idle for too long, though no timer has fired yet
                self._forget()
                latest, pending, seen = None, False, _Seen(self._seen)
                calls.clear()
            until = max(until, int(at) + self._ttl_ms)
            if not seen.add(_KEY, _known(event)):
                continue
            call, tool, is_edit, failed = _known(call), _known(tool), _known(is_edit), _known(failed)
            counts = found.setdefault(int(turn), [0] * len(COUNTS))
            if kind == "call":
                latest = call if call is not None else latest
                if tokens is not None and tool is not None:
                    tokens = frozenset(t for t in tokens if t is not None)
                    counts[3] += bool(tokens) and self._similar(tool, tokens, calls)
                calls.append((tool, frozenset() if tokens is None else tokens))
                if is_edit:
                    counts[4] += pending
                    pending = False
                    seen.add(_EDIT, call)
            elif kind == "result":
                if not seen.add(_DIGEST, _known(digest)):
                    counts[0] += 1
                    counts[2 if _known(cheap) else 1] += 1
                link = call if call is not None else latest
                if failed and link is not None and seen.holds(_EDIT, link):
                    pending = True
        seen.store()
        if until != deadline:
            self._handle.registerTimer(until)
        self._head.update((latest, pending, until, seen.parts, seen.size, [(tool, sorted(tokens)) for tool, tokens in calls]))
        for turn, counts in found.items():
            counts[5] = counts[0] + counts[3] + counts[4]
            if counts[5]:
                yield _RECEIPT(key[0], turn, *counts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The session was idle for its time to live: nothing of it is kept."""
        head = self._head.get()
        if head and expiredTimerInfo.getExpiryTimeInMs() >= head[2]:
            self._forget()
        return iter([])

    def _forget(self) -> None:
        self._head.clear()
        self._seen.clear()

    def close(self) -> None:
        pass


def thrash_stream(
    events: DataFrame, ttl: int = TTL_SECS, delay: str = "10 minutes", prior: int = PRIOR_CALLS, threshold: float = SIMILARITY
) -> DataFrame:
    """Receipts per (session, turn) of each micro-batch with any repetition; sums over batches are the turn's.

    A session that gets no event for ``ttl`` seconds of event time is forgotten, as a live session
    is; events behind the watermark are dropped.  Start it from ``stateful_session``.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # as in the assembler
    timed = events.where("session_id IS NOT NULL").withWatermark("event_time", delay)
    keyed = timed.withColumn("at", F.unix_millis("event_time")).select("session_id", "event_time", *_EVENT).groupBy("session_id")
    return keyed.transformWithState(Repeats(ttl * 1000, prior, threshold), OUTPUT, outputMode="Append", timeMode="EventTime")
