"""Content-addressed blobs, recovery maps and the ledgers around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlytics.functions import text as tx
from convlytics.plans.membership import one_of_each, without
from convlytics.plans.once import evaluate_once
from convlytics.plans.storage import fresh_path

DIGEST = "^[0-9a-fA-F]{64}$"
RETENTION_SECS = 30 * 24 * 3600


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def _recent(served_at: Column, now: Column | int, window: int) -> Column:
    now = now if isinstance(now, Column) else F.lit(now)
    return (served_at <= now) & (now - served_at <= window)


def put_blobs(incoming: DataFrame, existing: DataFrame | None = None, value_col: str = "bytes") -> DataFrame:
    """New ``(digest, bytes)`` rows: each content once, and only if not stored yet.

    Digests are counted and compared first; bytes move only where a digest is repeated or may be
    stored already, as a filter of fixed size tells.
    """
    keyed = evaluate_once(incoming, {"digest": digest(F.col(value_col))})
    fresh = keyed.select("digest", F.col(value_col).cast("binary").alias("bytes"))
    fresh = one_of_each(fresh, "digest")
    return fresh if existing is None else without(fresh, "digest", existing)


def get_blobs(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Look references up: found, unknown, corrupt or invalid_digest."""
    # Each blob is hashed once, however many references it has.
    stored = evaluate_once(blobs.select(F.col("digest").alias("__d"), "bytes"), {"__whole": digest(F.col("bytes")) == F.col("__d")})
    joined = refs.join(stored, F.col("digest") == F.col("__d"), "left")
    status = (
        F.when(~F.col("digest").rlike(DIGEST), "invalid_digest")
        .when(F.col("__d").isNull(), "unknown")
        .when(~F.col("__whole"), "corrupt")
        .otherwise("found")
    )
    return joined.withColumn("status", status).drop("__d", "__whole")


def verify_blobs(blobs: DataFrame) -> DataFrame:
    """Blobs whose content does not match their address."""
    return blobs.where(digest(F.col("bytes")) != F.col("digest"))


def put_originals(df: DataFrame, policy: str = "first_wins") -> DataFrame:
    """Recovery map of ``text`` to ``original``, keyed by the normalised hash of ``text``.

    ``first_wins`` keeps the first original of a key.  ``fail_closed`` returns the rows
    that agree with the first one, and marks the others as rejected.

    Texts are cleaned and hashed once and stored with their hashes; originals are compared by digest.
    """
    if policy not in ("first_wins", "fail_closed"):
        raise ValueError(f"unknown policy: {policy}")
    hashed = evaluate_once(df, {"key": tx.normalized_hash(F.col("text")), "__sum": digest(F.col("original"))})
    path = fresh_path(df.sparkSession, "originals")
    hashed.write.parquet(path)
    keyed = df.sparkSession.read.parquet(path)
    # The place of the first original is a hash aggregate of numbers; then one text per key is fetched.
    places = keyed.groupBy("key").agg(F.min("seq").alias("seq"))
    first = keyed.join(places, ["key", "seq"], "left_semi")
    if policy == "first_wins":
        return first.select("key", "seq", "original")
    winners = first.select(F.col("key").alias("__key"), F.col("__sum").alias("__winner"))
    joined = keyed.join(winners, F.col("key") == F.col("__key"))
    return joined.select(*df.columns, "key", (F.col("__sum") != F.col("__winner")).alias("rejected"))


def dedup_repeat_reads(
    results: DataFrame, served: DataFrame, now: int, max_age: int = 300, tag: str = "convlytics"
) -> DataFrame:
    """Turn a file read into a reference when its session has already read the same bytes.

    Columns of ``results``: ``session_id, seq, bytes``.  Bytes that were served within
    ``max_age`` seconds stay verbatim.  With a ``session_turn`` column, the reads of the
    request that opened a session are never referenced: the session did not exist yet.
    """
    keyed = evaluate_once(results, {"digest": digest(F.col("bytes"))})
    first = keyed.groupBy("session_id", "digest").agg(F.min("seq").alias("__first"))
    recent = (
        served.where(_recent(F.col("served_at_secs"), now, max_age))
        .select(F.col("digest").alias("__served"))
        .distinct()
    )
    # The first read of a digest is found by grouping, so nothing is ordered per session;
    # the lookup rows are one per (session, digest).
    slots = first.select(F.col("session_id").alias("__s"), F.col("digest").alias("__d"), "__first")
    slots = slots.join(recent, F.col("__d") == F.col("__served"), "left")
    joined = keyed.join(slots, (F.col("session_id") == F.col("__s")) & (F.col("digest") == F.col("__d")))
    referenced = (F.col("seq") > F.col("__first")) & F.col("__served").isNull()
    if "session_turn" in results.columns:
        referenced = referenced & (F.col("session_turn") > 1)
    return joined.select(
        *results.columns,
        "digest",
        referenced.alias("referenced"),
        F.when(referenced, F.concat(F.lit(f"[{tag}:file-ref:"), F.col("digest"), F.lit("]\n")))
        .otherwise(F.col("bytes").cast("string"))
        .alias("rendered"),
    )


def recently_served(served: DataFrame, now: int, window: int) -> DataFrame:
    return (
        served.where(F.col("digest").rlike(DIGEST) & _recent(F.col("served_at_secs"), now, window))
        .select("digest")
        .distinct()
    )


def collectable_blobs(
    blobs: DataFrame, session_blobs: DataFrame, live: DataFrame, served: DataFrame, now: int, window: int = 300
) -> DataFrame:
    """Blobs that no live session has seen and that were not served recently."""
    pinned = session_blobs.join(live.select("session_id"), "session_id", "left_semi").select("digest")
    # One row per digest: a content that everyone has seen must not load one task.
    pins = pinned.union(recently_served(served, now, window)).distinct()
    return without(blobs.where(F.col("digest").rlike(DIGEST)), "digest", pins)


def retain_served(served: DataFrame, now: int, max_age: int = RETENTION_SECS) -> DataFrame:
    """Drop entries older than ``max_age`` or in the future; unreadable times are kept."""
    at = F.col("served_at_secs")
    return served.where(at.isNull() | _recent(at, now, max_age))


def transform_savings(receipts: DataFrame, rendered: DataFrame) -> DataFrame:
    """Original and rendered bytes per transform; ``rendered`` has ``digest, transform, text``."""
    sizes = (
        rendered.withColumn("__n", F.octet_length("text"))
        .groupBy("digest", "transform")
        .agg(F.max("__n").alias("rendered_bytes"))
    )
    # Receipts of the same content are summed before they meet their rendered size.
    totals = receipts.groupBy("digest", "transform").agg(
        F.count(F.lit(1)).alias("receipts"), F.sum("original_bytes").alias("original_bytes")
    )
    joined = totals.join(sizes, ["digest", "transform"], "left")
    return joined.groupBy("transform").agg(
        F.sum("receipts").alias("receipts"),
        F.sum("original_bytes").alias("original_bytes"),
        F.sum(F.col("receipts") * F.coalesce("rendered_bytes", F.lit(0))).cast("bigint").alias("rendered_bytes"),
    )


def join_attestations(
    results: DataFrame, attestations: DataFrame, location: list[str], value_col: str = "bytes"
) -> DataFrame:
    """Attach metadata where digest and location both match; repeated digests are unusable."""
    meta = [c for c in attestations.columns if c not in ("digest", *location)]
    usable = (
        attestations.groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            *[F.first(c).alias(c) for c in (*location, *meta)],
        )
        .where("__n = 1")
        .drop("__n")
    )
    keyed = evaluate_once(results, {"digest": digest(F.col(value_col))})
    return keyed.join(usable, ["digest", *location])
