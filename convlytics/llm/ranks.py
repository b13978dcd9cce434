"""Positions of rows inside ordered groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlytics.llm.common import cut


def met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", *, only: Column | None = None) -> DataFrame:
    """``a`` joined to ``b`` on keys of equal names, NULL meeting NULL; ``only`` bounds the rows of ``a`` that meet any."""
    other = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    alike = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(other, [*alike, *([] if only is None else [only])], how).drop(*(f"__{k}" for k in keys))


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], position: str, size: str) -> DataFrame:
    """``rows`` with the 0-based ``position`` in the group and the group's ``size``; NULL is a group.

    The rows are dealt by ranges of (group, order), so a large group spans many tasks; within a
    task they are sorted by Spark.  Each range counts its rows by group and is told how many lie
    before it: the only window sees one row per (group, range).
    """
    keys = [F.col(k) for k in group]
    by = [*keys, *(F.col(c) if isinstance(c, str) else c for c in order)]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = cut(dealt, "placed").withColumn("__range", F.shiftright("__at", 33))
    counts = placed.groupBy(*group, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(*keys) if group else Window.partitionBy(F.lit(0))
    before = F.sum("__n").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    counts = counts.select(*group, "__range", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("__size"))
    return met(placed, counts, [*group, "__range"]).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias(position), F.col("__size").alias(size))
