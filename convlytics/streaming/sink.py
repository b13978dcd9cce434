"""Write a stream's micro-batches so that retries do not repeat rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from convlytics.plans.storage import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose keyed state lives in RocksDB."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.checkpoint.dir"):
        value = spark.conf.get(key, None)
        if value is not None and session.conf.isModifiable(key):
            session.conf.set(key, value)
    return session


def write_batches(
    stream: DataFrame, path: str, output_mode: str = "append", transform: Callable | None = None
) -> StreamingQuery:
    """Start a query that stores micro-batch ``n`` as ``path/batch=n``.

    A retried batch overwrites its own folder.
    """

    def store(batch: DataFrame, number: int) -> None:
        rows = transform(batch, number) if transform else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(store)
        .outputMode(output_mode)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def run_available(
    stream: DataFrame, name: str, output_mode: str = "append", transform: Callable | None = None
) -> str:
    """Process everything that is available and return the folder of batches."""
    path = fresh_path(stream.sparkSession, name)
    query = write_batches(stream, path, output_mode, transform)
    query.awaitTermination()
    return path
