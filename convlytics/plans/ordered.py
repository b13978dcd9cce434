"""Ordered, per-key computations that stay balanced when one key is very large.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task.  The helpers
here cut each key into blocks ``order div span``.  The order column is unique inside a
key, so a block never holds more than ``span`` rows.  Each block is scanned by itself; a
summary of one row per (key, block) carries the state from earlier blocks and is joined
back on (key, block), which is the partitioning the rows already have.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = 1 << 20
_BLOCK = "__block"


def _ordered(keys: Sequence[str], order: str, reverse: bool = False):
    column = F.col(order).desc() if reverse else F.col(order)
    return Window.partitionBy(*keys).orderBy(column)


def _blocked(df: DataFrame, order: str, span: int) -> DataFrame:
    return df.withColumn(_BLOCK, F.floor(F.col(order) / F.lit(span)).cast("bigint"))


def _join_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe join of block summaries back to their rows."""
    renamed = carry.select(
        *[F.col(k).alias(f"__c_{k}") for k in (*keys, _BLOCK)],
        *[c for c in carry.columns if c not in (*keys, _BLOCK)],
    )
    condition = None
    for key in (*keys, _BLOCK):
        part = F.col(key).eqNullSafe(F.col(f"__c_{key}"))
        condition = part if condition is None else condition & part
    return rows.join(renamed, condition, "left").drop(*[f"__c_{k}" for k in (*keys, _BLOCK)])


def _by_block(df: DataFrame, keys: Sequence[str], order: str, span: int, values: dict[str, Column]) -> DataFrame:
    """The rows with their block and the values, in one exchange for the scan and the summaries."""
    return _blocked(df, order, span).withColumns(values).repartition(*keys, _BLOCK)


def _summaries(rows: DataFrame, keys: Sequence[str], totals: Sequence[Column]) -> DataFrame:
    """One row per key and block.

    Looking at all columns keeps this branch on the very exchange that the scan uses, so the
    input is read and moved once; the aggregate itself holds only keys, totals and that check.
    """
    entries = [F.map_entries(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in rows.schema.fields]
    return rows.groupBy(*keys, _BLOCK).agg(*totals, F.bit_xor(F.xxhash64(*entries)).alias("__read")).where("__read IS NOT NULL")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column], span: int = SPAN
) -> DataFrame:
    """Add inclusive running sums per key, in ``order``.

    Select the columns you need first: the scan keeps all of them.
    """
    inputs = {f"__v_{name}": F.coalesce(expr, F.lit(0)) for name, expr in sums.items()}
    rows = _by_block(df, keys, order, span, inputs)
    inside = _ordered([*keys, _BLOCK], order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({name: F.sum(f"__v_{name}").over(inside) for name in sums})
    before = _ordered(keys, _BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = _summaries(rows, keys, [F.sum(f"__v_{name}").alias(name) for name in sums])
    edges = totals.select(*keys, _BLOCK, *[F.sum(name).over(before).alias(f"__k_{name}") for name in sums])
    joined = _join_carry(local, edges, keys)
    total = {
        name: F.col(name) + F.coalesce(F.col(f"__k_{name}"), F.lit(0)) for name in sums
    }
    extra = [f"__{kind}_{name}" for kind in "vk" for name in sums]
    return joined.withColumns(total).drop(_BLOCK, *extra)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: str, out: str, span: int = SPAN
) -> DataFrame:
    """Add the 1-based dense position of each row inside its key."""
    return running_sum(df, keys, order, {out: F.lit(1).cast("bigint")}, span)


@dataclass(frozen=True)
class Nearest:
    """A value to look up in neighbouring rows.

    The nearest earlier (or, with ``forward``, later) row where ``value`` is not null;
    ``inclusive`` lets the row's own value count.
    """

    value: Column
    inclusive: bool = True
    forward: bool = False


def carry(
    df: DataFrame, keys: Sequence[str], order: str, lookups: dict[str, Nearest], span: int = SPAN
) -> DataFrame:
    """Add, per row, the nearest non-null value of each lookup in both directions.

    This is an as-of lookup without pairing rows: both sides live in one table ordered
    by ``order``.
    """
    rows = _by_block(df, keys, order, span, {f"__v_{n}": look.value for n, look in lookups.items()})

    def beyond(name: str, look: Nearest) -> Column:
        outer = _ordered(keys, _BLOCK, look.forward).rowsBetween(Window.unboundedPreceding, -1)
        return F.last(f"__s_{name}", ignorenulls=True).over(outer).alias(f"__k_{name}")

    def inside(name: str, look: Nearest, end: int) -> Column:
        near = _ordered([*keys, _BLOCK], order, look.forward).rowsBetween(Window.unboundedPreceding, end)
        return F.last(f"__v_{name}", ignorenulls=True).over(near)

    # A block hands on the last value seen at its end in the direction of the lookup.
    handed = [
        (F.min_by if look.forward else F.max_by)(
            f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))
        ).alias(f"__s_{n}")
        for n, look in lookups.items()
    ]
    edges = _summaries(rows, keys, handed).select(*keys, _BLOCK, *[beyond(n, look) for n, look in lookups.items()])
    local = rows.withColumns(
        {n: inside(n, look, 0 if look.inclusive else -1) for n, look in lookups.items()}
    )
    joined = _join_carry(local, edges, keys)
    found = {n: F.coalesce(F.col(n), F.col(f"__k_{n}")) for n in lookups}
    return joined.withColumns(found).drop(
        _BLOCK, *[f"__{kind}_{n}" for kind in "vk" for n in lookups]
    )


def with_halo(
    df: DataFrame, position: str, before: int, block: str, own: str, rows: int = 1 << 14
) -> DataFrame:
    """Cut dense positions into blocks and copy each block's last rows to the next one.

    A frame of up to ``before`` preceding rows is then complete for every row whose
    ``own`` flag is true, inside groups of at most ``rows + before`` rows.
    """
    if before >= rows:
        raise ValueError("the halo must be shorter than a block")
    home = F.floor((F.col(position) - 1) / F.lit(rows)).cast("bigint")
    last_rows = ((F.col(position) - 1) % rows) >= rows - before
    copies = F.when(last_rows, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn(block, F.explode(copies)).withColumn(own, F.col(block) == home)


def lower_median(df: DataFrame, keys: Sequence[str], value: str, out: str, times: str | None = None) -> DataFrame:
    """Exact element ``(n - 1) div 2`` of the sorted, non-negative values of each key.

    Equal values are counted before the shuffle; ``times`` names the column that says how
    often a row counts.  A logarithmic histogram locates the
    bucket that holds the median; only that bucket's values are ranked.
    """
    bucket = F.when(F.col(value) > 0, F.floor(F.log2(F.col(value)) * 4096)).otherwise(
        F.lit(-(1 << 40))
    )
    counted = (
        df.groupBy(*keys, value)
        .agg((F.sum(times) if times else F.count(F.lit(1))).alias("__n"))
        .withColumn("__bucket", bucket.cast("bigint"))
    )
    histogram = counted.groupBy(*keys, "__bucket").agg(F.sum("__n").alias("__bn"))
    by_bucket = Window.partitionBy(*keys).orderBy("__bucket")
    upto = F.sum("__bn").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__bn").over(Window.partitionBy(*keys))
    target = (
        histogram.select(*keys, "__bucket", "__bn", upto.alias("__upto"), total.alias("__total"))
        .withColumn("__rank", F.expr("(__total + 1) div 2") - (F.col("__upto") - F.col("__bn")))
        .where("__rank between 1 and __bn")
        .select(*[F.col(k).alias(f"__t_{k}") for k in keys], F.col("__bucket").alias("__tb"), "__rank")
    )
    condition = F.col("__bucket") == F.col("__tb")
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__t_{key}"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value)
    ranked = counted.join(target, condition).withColumn(
        "__cum", F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    hit = ranked.where("__cum >= __rank and __cum - __n < __rank")
    return hit.select(*keys, F.col(value).alias(out))
