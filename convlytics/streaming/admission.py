"""What happens to rows at a stream's edge: kept, late or dated in the future.

A watermark drops late rows without a word.  Here every micro-batch is split, so that what is
behind the watermark or ahead of the clock goes to a side output and can be counted or replayed.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT, LATE, FUTURE = "kept", "late", "future"


class Admission:
    """A ``foreachBatch`` transform that adds ``fate`` to each row.

    The watermark is the latest kept time of the batches before, less ``delay_secs``; it is stored
    by batch number, so a repeated batch is judged like the first time.  Rows more than
    ``ahead_secs`` ahead of ``clock`` are refused and do not move it.  Rows without a time are kept.
    """

    def __init__(self, spark: SparkSession, path: str, at: Column, *, delay_secs: int = 600, ahead_secs: int = 0, clock: Callable[[], float] = time.time):
        self._spark, self._path, self._at = spark, path, at
        self._delay, self._ahead, self._clock = delay_secs, ahead_secs, clock

    def _mark(self, number: int) -> int | None:
        """The latest kept time up to a batch."""
        if number < 0:
            return None
        return self._spark.read.schema("mark bigint").parquet(f"{self._path}/marks/batch={number}").first()[0]

    def __call__(self, batch: DataFrame, number: int) -> DataFrame:
        mark, now = self._mark(number - 1), int(self._clock())
        late = F.lit(False) if mark is None else F.col("__at") < mark - self._delay
        fate = F.when(F.col("__at") > now + self._ahead, FUTURE).when(late, LATE).otherwise(KEPT)
        path = f"{self._path}/rows/batch={number}"
        batch.withColumn("__at", self._at.cast("bigint")).withColumn("fate", fate).write.mode("overwrite").parquet(path)
        rows = self._spark.read.parquet(path)
        latest = F.greatest(F.max(F.when(F.col("fate") == KEPT, F.col("__at"))), F.lit(mark).cast("bigint"))
        rows.agg(latest.alias("mark")).write.mode("overwrite").parquet(f"{self._path}/marks/batch={number}")
        return rows.drop("__at")
