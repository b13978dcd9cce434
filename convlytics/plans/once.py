"""Keep costly expressions from being evaluated more than once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add computed columns that later filters and joins see as plain attributes.

    The optimizer copies a projected expression into every filter that uses it, and
    adds null checks for join keys; for a parsed, cleaned or hashed text each copy costs
    as much as the first.  A one-element generator yields the same columns, and filters
    on its output stay above it.
    """
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame (a global aggregate) to every row of ``df``.

    The frame becomes a scalar subquery: it runs once and no join takes place.  Without a
    row the columns are NULL.
    """
    packed = row.select(F.struct(*row.columns).alias("row")).scalar()
    return df.withColumn("__row", packed).select(*df.columns, "__row.*")
