"""The served log as a stream that forgets: entries leave when they are older than their retention.

Micro-batches are stored by batch number and day; when the clock has passed a day's retention, its
folders are deleted, so what is kept is bounded by the retention whatever has been served before.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from convlytics.operators.store import RETENTION_SECS, retain_served

DAY = 86_400
UNTIMED = "none"


class RetainedLog:
    """Entries ``digest, served_at_secs`` below ``path``; rows without a readable time are kept."""

    def __init__(self, spark: SparkSession, path: str, max_age: int = RETENTION_SECS, clock: Callable[[], float] = time.time):
        self._spark, self._path, self._max_age, self._clock = spark, path, max_age, clock

    def _folders(self, pattern: str) -> list:
        jvm = self._spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self._path}/{pattern}")
        fs = place.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        return [(fs, f.getPath()) for f in fs.globStatus(place) or []]

    def store(self, batch: DataFrame, number: int) -> None:
        """Add a micro-batch (a repeated one overwrites itself) and let old days go."""
        kept = retain_served(batch, int(self._clock()), self._max_age)
        day = F.coalesce(F.floor(F.col("served_at_secs") / DAY).cast("string"), F.lit(UNTIMED))
        kept.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{self._path}/batch={number}")
        self.expire()

    def expire(self) -> int:
        """Delete the folders of days that are past their retention; returns how many."""
        oldest = int(self._clock()) - self._max_age
        gone = 0
        for fs, folder in self._folders("batch=*/day=*"):
            day = folder.getName().removeprefix("day=")
            if day != UNTIMED and (int(day) + 1) * DAY <= oldest:
                fs.delete(folder, True)
                gone += 1
        return gone

    def entries(self) -> DataFrame:
        """What is retained now; the day that is partly past is cut by its rows."""
        schema = "digest string, served_at_secs bigint"
        if not self._folders("batch=*/day=*"):
            return self._spark.createDataFrame([], schema)
        rows = self._spark.read.schema(f"{schema}, batch int, day string").parquet(self._path).select("digest", "served_at_secs")
        return retain_served(rows, int(self._clock()), self._max_age)


def retain_stream(served: DataFrame, log: RetainedLog, checkpoint: str) -> StreamingQuery:
    """Keep a log up to date with what is served."""
    rows = served.select("digest", F.col("served_at_secs").cast("bigint").alias("served_at_secs"))
    return rows.writeStream.foreachBatch(log.store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
