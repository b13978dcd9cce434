"""Sessions assigned while requests arrive.

Requests that share their first message are one key.  They wait in keyed state until the
watermark has passed them, so their order of arrival does not matter; then they are assigned in
the order of their times: a request joins the live session of its key or opens a new one.  A key
without waiting requests is forgotten once its session has been idle for its time to live.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from convlytics.operators.sessions import TTL_SECS, message_digest

OUTPUT = "request_id string, session_id string, opened boolean"


def _session(opener: str) -> str:
    return hashlib.sha256(opener.encode()).hexdigest()


class Stitcher(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._session = handle.getValueState("session", "opener STRING, last BIGINT")
        self._next = handle.getValueState("next", "at BIGINT")
        self._waiting = handle.getListState("waiting", "request_id STRING, seq BIGINT, at BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # requests without messages share nothing
            for batch in rows:
                ids = batch["request_id"]
                yield pd.DataFrame({"request_id": ids, "session_id": ids.map(_session), "opened": True})
            return
        first = None
        for batch in rows:
            at = [int(t.timestamp() * 1000) for t in batch["event_time"]]
            self._waiting.appendList(list(zip(batch["request_id"], batch["seq"].astype(int).tolist(), at, strict=True)))
            first = min(at) if first is None else min(first, *at)
        self._wake(first)

    def _wake(self, at: int) -> None:
        """One timer a key: the earliest of what it waits for."""
        now = self._next.get()
        if now and now[0] <= at:
            return
        if now:
            self._handle.deleteTimer(now[0])
        self._handle.registerTimer(at)
        self._next.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self._waiting.get(), key=lambda r: (r[2], r[1], r[0]))
        due = [r for r in waiting if r[2] <= passed]
        later = waiting[len(due) :]
        opener, last = self._session.get() or (None, 0)
        out = []
        for request, _, at in due:
            opens = opener is None or at - last > self._ttl_ms
            if opens:
                opener = request
            last = at
            out.append((request, _session(opener), opens))
        self._next.clear()
        if due:
            self._waiting.put(later) if later else self._waiting.clear()
            self._session.update((opener, last))
        if later:
            self._wake(later[0][2])
        elif opener is not None and passed > last + self._ttl_ms:
            self._session.clear()
        elif opener is not None:
            self._wake(last + self._ttl_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=["request_id", "session_id", "opened"])

    def close(self) -> None:
        pass


def stitch_stream(requests: DataFrame, ttl: int = TTL_SECS, delay: str = "10 minutes") -> DataFrame:
    """``request_id, session_id, opened`` of each request that the watermark has passed.

    ``requests``: ``request_id, seq, event_time, first_message``.  The result equals the batch
    form on the same rows, in whatever order they arrive within ``delay``.  Start it from
    ``stateful_session``.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    keyed = requests.withWatermark("event_time", delay).select(
        F.col("request_id").cast("string").alias("request_id"), F.col("seq").cast("bigint").alias("seq"), "event_time",
        message_digest(F.col("first_message")).alias("conversation"),
    )
    return keyed.groupBy("conversation").transformWithStateInPandas(Stitcher(ttl * 1000), OUTPUT, outputMode="Append", timeMode="EventTime")
