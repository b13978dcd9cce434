"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlytics.plans.packaging import ship_package
from convlytics.plans.storage import fresh_path, shared_dir

_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a frame to the shared folder and read it back: its lineage ends there.  Also the table's path."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def released(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`written`; the shuffle files behind the table go at once, not when the driver collects its garbage."""
    conf = df.sparkSession.conf
    old = conf.get(_SHUFFLES_GO, None)
    conf.set(_SHUFFLES_GO, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(_SHUFFLES_GO) if old is None else conf.set(_SHUFFLES_GO, old)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that `written` made, once nothing reads it any more."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError(f"{path} is no intermediate table")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def marked_ids(ids: DataFrame, id_col: str, bits: int = 1 << 24) -> DataFrame:
    """Bitmap of hashed ids: at most ``bits / 32768`` rows of 4 KB, so 2 MB whatever the input."""
    place = _place(F.col(id_col), bits)
    return ids.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits"))


def maybe_marked(rows: DataFrame, id_col: str, marks: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """The rows whose id is marked, and a few others: a filter before a join that moves wide rows.

    The bitmap's size is fixed, so it is broadcast; where it is full, all rows pass.
    """
    place = _place(F.col(id_col), bits)
    met = rows.withColumn("__place", place).join(F.broadcast(marks), F.bitmap_bucket_number("__place") == F.col("__bucket"))
    at = F.bitmap_bit_position("__place")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.filter(F.getbit(byte, (at % 8).cast("int")) == 1).drop("__place", "__bucket", "__bits")


def _place(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(bits).cast("long"))


def frugal(rows: Iterator) -> Iterator:
    """The same values; at the end the worker, which lives on, gives free memory back."""
    yield from rows
    release_free()


def release_free() -> None:
    """Give freed memory back to the system, Arrow's and that of the C library."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(lambda batches: frugal(fn(batches)), schema)


def in_pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most_bytes``; one longer value is a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.nbytes <= most_bytes:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of a partition that is sorted by ``keys``: (key, rows), one group in memory at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i, value in enumerate(values):
            if value != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield last, pa.Table.from_batches(held)
                held, start, last = [], i, value
        held.append(batch.slice(start))
    if held:
        yield last, pa.Table.from_batches(held)
