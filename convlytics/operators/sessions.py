"""Sessions: stitching requests, liveness, turn numbers and conversation starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlytics.functions import text as tx
from convlytics.plans.once import evaluate_once
from convlytics.plans.ordered import SPAN, number_rows, running_sum

TTL_SECS = 3600


def message_digest(message: Column) -> Column:
    return F.sha2(message.cast("binary"), 256)


def stitch_sessions(requests: DataFrame, ttl: int = TTL_SECS) -> DataFrame:
    """Assign each request to a session: ``session_id`` and whether it opened it.

    ``requests``: ``request_id, seq, at_secs, first_message``.  A request joins the live
    session that shares the longest prefix of its messages.  Sharing any prefix means
    sharing the first message, and while such a session lives every such request joins
    it, so no second one can start.  A session is therefore a run of requests with one
    first message and no gap above ``ttl``.  Requests without messages share nothing and
    stand alone.

    Runs are found on summaries of one row per first message and ``ttl``-wide time slot
    (requests in one slot are never more than ``ttl`` apart), not on the requests.
    """
    slot = F.floor(F.col("at_secs") / F.lit(max(ttl, 1))).cast("bigint")
    keyed = evaluate_once(requests, {"__k": message_digest(F.col("first_message")), "__slot": slot})
    started = keyed.where("__k IS NOT NULL")
    slots = started.groupBy("__k", "__slot").agg(
        F.min("at_secs").alias("__from"),
        F.max("at_secs").alias("__to"),
        F.min(F.struct("seq", "request_id")).alias("__first"),
    )
    by_key = Window.partitionBy("__k").orderBy("__slot")
    gap = F.col("__from") - F.lag("__to").over(by_key) > ttl
    opens = F.coalesce(gap, F.lit(True))
    runs = slots.withColumn("__opener", F.when(opens, F.col("__first.request_id")))
    runs = runs.withColumn(
        "__opener", F.last("__opener", ignorenulls=True).over(by_key)
    ).select(F.col("__k").alias("__rk"), F.col("__slot").alias("__rs"), "__opener")
    joined = keyed.join(
        runs, (F.col("__k") == F.col("__rk")) & (F.col("__slot") == F.col("__rs")), "left"
    )
    opener = F.coalesce("__opener", "request_id")
    return joined.select(
        *requests.columns,
        F.sha2(opener.cast("string").cast("binary"), 256).alias("session_id"),
        (opener == F.col("request_id")).alias("opened"),
    )


def prefix_keys(messages: DataFrame, owner: str, span: int = SPAN) -> DataFrame:
    """One row per message with a key of the history up to and including it.

    ``messages``: ``owner, pos, message`` with ``pos`` from 0.  The key is two running
    sums of 60-bit hashes of (position, message): equal histories have equal keys, and
    sums, unlike chained hashes, can be carried across blocks of a long history.
    """
    hashed = evaluate_once(
        messages.select(owner, "pos", "message"),
        {"h": F.sha2(F.concat(F.col("pos").cast("string"), F.lit("\n"), "message").cast("binary"), 256)},
    )

    def part(start: int) -> Column:
        return F.conv(F.substring("h", start, 15), 16, 10).cast("decimal(20,0)")

    sums = running_sum(hashed, [owner], "pos", {"a": part(1), "b": part(16)}, span)
    return sums.select(owner, "pos", "a", "b")


def match_sessions(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Match request histories against a table of live session histories.

    ``requests``: ``request_id, pos, message``; ``sessions``: ``session_id, pos,
    message``.  The unique longest common prefix wins; a tie is a collision and opens a
    new session.  Sessions are counted per prefix first, so a prefix shared by many
    sessions is one row and no pairs are formed.
    """
    prefix = ["pos", "a", "b"]
    counted = prefix_keys(sessions, "session_id").groupBy(*prefix).agg(
        F.count(F.lit(1)).alias("__n"), F.min("session_id").alias("__session")
    )
    asked = prefix_keys(requests, "request_id").join(counted, prefix, "left")
    found = F.when(F.col("__n").isNotNull(), F.struct("pos", "__n", "__session"))
    best = asked.groupBy("request_id").agg(F.max(found).alias("__best"))
    unique = F.col("__best.__n") == 1
    return best.select(
        "request_id",
        F.when(unique, F.col("__best.__session")).alias("session_id"),
        F.coalesce(~unique, F.lit(False)).alias("collision"),
    )


def live_sessions(
    accesses: DataFrame, now: Column | int, ttl: int = TTL_SECS, cap: int | None = None
) -> DataFrame:
    """Sessions idle for at most ``ttl``; with a ``cap``, that many of the last used ones.

    The cap is a top-k report over one row per session; without it all live sessions return.
    """
    now = now if isinstance(now, Column) else F.lit(now)
    last = accesses.groupBy("session_id").agg(
        F.max("at_secs").alias("last_access_secs"), F.max(now).alias("__now")
    )
    idle = F.greatest(F.col("__now") - F.col("last_access_secs"), F.lit(0))
    live = last.where(idle <= ttl).drop("__now")
    if cap is None:
        return live
    return live.orderBy(F.desc("last_access_secs"), F.desc("session_id")).limit(cap)


def number_turns(requests: DataFrame, span: int = SPAN) -> DataFrame:
    """Add ``session_turn``: 1, 2, 3 … per session in request order."""
    return number_rows(requests, ["session_id"], "seq", "session_turn", span)


def conversation_start(messages: DataFrame) -> DataFrame:
    """Per request: exactly one user message and no assistant message."""
    return messages.groupBy("request_id").agg(
        (
            (F.count_if(F.col("role") == "user") == 1) & (F.count_if(F.col("role") == "assistant") == 0)
        ).alias("conversation_start")
    )


def last_user_text(messages: DataFrame) -> DataFrame:
    """The text of the last message when it is a user turn with text.

    Block lists count only where the protocol allows them, and must hold visible text.
    """
    last = messages.groupBy("request_id").agg(
        F.max_by(F.struct("provider", "role", "text", "is_plain_text"), "pos").alias("m")
    )
    anthropic = F.col("m.provider") == "anthropic"
    usable = F.when(anthropic, ~tx.is_blank(F.col("m.text"))).otherwise(F.col("m.is_plain_text"))
    return last.where((F.col("m.role") == "user") & usable).select(
        "request_id", F.col("m.text").alias("text")
    )
