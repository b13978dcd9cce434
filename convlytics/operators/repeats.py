"""Tool events and the repetition found in them.

Events: ``session_id, seq, session_turn, event_key, kind (call | result), call_key, tool,
tokens, is_edit, digest, wire_cheap, failed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlytics.plans.once import evaluate_once
from convlytics.plans.ordered import SPAN, Nearest, carry, number_rows, running_sum, with_halo
from convlytics.plans.storage import fresh_path

PRIOR_CALLS = 128
SIMILARITY = 0.60

# A tool whose name holds one of these words edits files.
EDIT_WORDS = ["edit", "write", "patch", "apply", "replace", "update"]


def drop_replays(events: DataFrame) -> DataFrame:
    """Keep the first event of each key per session.

    Keys repeat when a request re-sends its history.  The first place of each key is a hash
    aggregate of numbers; the events themselves move once, to meet it.
    """
    first = events.groupBy(F.col("session_id").alias("__s"), F.col("event_key").alias("__k")).agg(F.min("seq").alias("__seq"))
    same = F.col("session_id").eqNullSafe(F.col("__s")) & F.col("event_key").eqNullSafe(F.col("__k")) & (F.col("seq") == F.col("__seq"))
    return events.join(first, same, "left_semi")


def link_results(events: DataFrame, span: int = SPAN) -> DataFrame:
    """Results without a call key belong to the latest call of their session."""
    calls = Nearest(F.when(F.col("kind") == "call", F.col("call_key")))
    placed = carry(events, ["session_id"], "seq", {"__latest": calls}, span)
    return placed.withColumn("call_key", F.coalesce("call_key", "__latest")).drop("__latest")


def exact_repeats(events: DataFrame) -> DataFrame:
    """Per (session, turn): results whose digest the session has already seen.

    Copies are counted per (session, digest, turn) before the first one is looked up, so
    a digest that fills a third of the ledger travels as a few counts.
    """
    results = events.where("kind = 'result'")
    counted = results.groupBy("session_id", "digest", "session_turn").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("wire_cheap").alias("cheap"),
        F.min(F.struct("seq", "wire_cheap")).alias("__first"),
    )
    first = counted.groupBy("session_id", "digest").agg(F.min("__first").alias("__open"))
    lookup = first.select(
        F.col("session_id").alias("__s"), F.col("digest").alias("__d"), "__open"
    )
    joined = counted.join(
        lookup, (F.col("session_id") == F.col("__s")) & F.col("digest").eqNullSafe(F.col("__d"))
    )
    opens = F.col("__first.seq") == F.col("__open.seq")
    n = F.col("n") - opens.cast("bigint")
    cheap = F.col("cheap") - (opens & F.col("__open.wire_cheap")).cast("bigint")
    return (
        joined.withColumn("__n", n)
        .withColumn("__cheap", cheap)
        .groupBy("session_id", "session_turn")
        .agg(
            F.sum("__n").alias("exact_repeated_tool_results"),
            F.sum(F.col("__n") - F.col("__cheap")).alias("expensive_exact_repeated_tool_results"),
            F.sum("__cheap").alias("wire_cheap_exact_repeated_tool_results"),
        )
        .where("exact_repeated_tool_results > 0")
    )


def similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token sets; 0 when both are empty."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(F.array_union(left, right))
    return F.coalesce(shared / F.nullif(union, F.lit(0)), F.lit(0.0))


def _signature(tokens: Column) -> Column:
    """A bit per token hash: a bit that the other set lacks is a token that it lacks."""
    one = F.lit(1).cast("bigint")
    bit = lambda t: F.call_function("shiftleft", one, F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda s, t: s.bitwiseOR(bit(t)))


def near_repeats(
    events: DataFrame, prior: int = PRIOR_CALLS, threshold: float = SIMILARITY, block_rows: int = 1 << 10
) -> DataFrame:
    """Calls with a similar but different earlier call of the same tool.

    Only the ``prior`` calls before a call count.  Calls are numbered inside their
    session, cut into blocks, and each block is given the last ``prior`` rows of the one
    before it: no group grows with its session.  A block is one array, of which a call looks
    at a slice; sizes and 64-bit signatures of the token sets bound what two calls can share,
    and only pairs that pass both bounds are intersected.
    """
    calls = events.where("kind = 'call'").select(
        "session_id", "seq", "session_turn", "tool", F.sort_array(F.array_distinct("tokens")).alias("tokens")
    )
    signed = evaluate_once(calls, {"tokens": F.col("tokens"), "n": F.size("tokens"), "bits": _signature(F.col("tokens"))})
    placed = number_rows(signed, ["session_id"], "seq", "position")
    blocks = with_halo(placed, "position", prior, "block", "own", block_rows)
    row = F.struct("position", "own", "seq", "session_turn", "tool", "n", "bits", "tokens")
    whole = blocks.groupBy("session_id", "block").agg(F.array_sort(F.collect_list(row)).alias("calls"))

    def lacking(a: Column, b: Column) -> Column:
        return F.bit_count(a["bits"].bitwiseAND(F.bitwise_not(b["bits"])))

    def similar(p: Column, c: Column) -> Column:
        least = (p["n"] + c["n"]) * (threshold / (1 + threshold)) - 1e-9  # tokens that both must have
        return (
            (p["tool"] == c["tool"]) & (p["n"] >= least) & (c["n"] >= least)
            & (c["n"] - lacking(c, p) >= least) & (p["n"] - lacking(p, c) >= least)
            & (p["tokens"] != c["tokens"]) & (similarity(p["tokens"], c["tokens"]) >= threshold)
        )

    def repeats(c: Column, i: Column) -> Column:
        before = F.slice(F.col("calls"), F.greatest(i - prior, F.lit(0)) + 1, F.least(i, F.lit(prior)))
        return c["own"] & F.exists(before, lambda p: similar(p, c))

    hits = whole.select("session_id", F.explode(F.filter("calls", repeats)).alias("c"))
    return hits.select("session_id", "c.seq", "c.session_turn", "c.tool")


def edit_fail_edit(events: DataFrame) -> DataFrame:
    """Edit calls that follow a failed result of an edit since the last edit call."""
    edits = (
        events.where("kind = 'call' AND is_edit")
        .groupBy("session_id", "call_key")
        .agg(F.min("seq").alias("__since"))
        .select(F.col("session_id").alias("__s"), F.col("call_key").alias("__k"), "__since")
    )
    edit = (F.col("kind") == "call") & F.col("is_edit")
    relevant = events.where(edit | ((F.col("kind") == "result") & F.col("failed")))
    joined = relevant.join(
        edits,
        (F.col("session_id") == F.col("__s"))
        & (F.col("call_key") == F.col("__k"))
        & (F.col("kind") == "result")
        & (F.col("seq") > F.col("__since")),
        "left",
    )
    failed = (F.col("kind") == "result") & F.col("__k").isNotNull()
    rows = joined.where(edit | failed).select(
        "session_id", "seq", "session_turn", edit.alias("is_call")
    )
    runs = running_sum(rows, ["session_id"], "seq", {"run": F.col("is_call").cast("bigint")})
    # Every run opens with an edit call, and run r is judged by the call that opens r + 1.
    # The first run may have no opening call, and results before any edit never link.
    by_run = runs.groupBy("session_id", "run").agg(
        F.min_by("session_turn", F.when(F.col("is_call"), F.col("seq"))).alias("opened_by_turn"),
        F.min(F.when(F.col("is_call"), F.col("seq"))).alias("opened_at"),
        F.bool_or(~F.col("is_call")).alias("failed"),
    )
    failing = by_run.where("failed").select(
        "session_id", (F.col("run") + 1).alias("run")
    )
    return by_run.where("opened_at IS NOT NULL").join(failing, ["session_id", "run"], "left_semi").select(
        "session_id", F.col("opened_at").alias("seq"), F.col("opened_by_turn").alias("session_turn")
    )


def thrash_receipts(events: DataFrame) -> DataFrame:
    """Per request with any repetition: the three counts and their sum."""
    # Seven scans read the cleaned events, each other columns: replays are looked for once, before them.
    path = fresh_path(events.sparkSession, "clean-events")
    cleaned = drop_replays(events)
    cleaned.write.parquet(path)
    clean = events.sparkSession.read.schema(cleaned.schema).parquet(path)
    # Only the edit cycles look at which call a result belongs to.
    used = ["session_id", "seq", "session_turn", "kind", "call_key", "is_edit", "failed"]
    cycles = edit_fail_edit(link_results(clean.select(*used)))
    return receipts_from(exact_repeats(clean), near_repeats(clean), cycles)


def receipts_from(exact: DataFrame, near: DataFrame, cycles: DataFrame) -> DataFrame:
    """Put the three kinds of repetition together per request."""
    keys = ["session_id", "session_turn"]
    near = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("near_repeated_tool_calls"))
    cycles = cycles.groupBy(*keys).agg(F.count(F.lit(1)).alias("edit_fail_edit_cycles"))
    joined = exact.join(near, keys, "full").join(cycles, keys, "full")
    counts = [c for c in joined.columns if c not in keys]
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return filled.withColumn(
        "score",
        F.col("exact_repeated_tool_results")
        + F.col("near_repeated_tool_calls")
        + F.col("edit_fail_edit_cycles"),
    )


def is_edit_tool(name: Column) -> Column:
    low = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low.rlike("|".join(EDIT_WORDS))
