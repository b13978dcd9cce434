"""Read and append the JSON ledgers.

Readers give every row a ``seq`` in append order: appends by time, files by name, lines by offset.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from convlytics.operators.store import DIGEST
from convlytics.plans.storage import shared_dir
from convlytics.sources import schemas


def provider_name(raw: Column) -> Column:
    """Display name of a provider written as text or as ``{"other": name}``."""
    other = F.get_json_object(raw, "$.other")
    return F.when(raw == "open_ai", "openai").otherwise(F.coalesce(other, raw))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


_ROW_IN_PARTITION = (1 << 33) - 1
_BATCH = "append-"


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def _file_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``__file, __first``: the first ``seq`` of each file, in append order.

    Batches of ``append_ledger`` carry their time in the name of their folder; other files
    count by the time they were last changed.  Files of one time go by name, and the rotated
    ``.1`` backup comes before its ledger.  The listing reads no content, and the running sum
    has one narrow row per file; a file takes its size and 2^33 places, so a billion fit.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    batch = F.regexp_extract("path", rf"/{_BATCH}(\d{{20}})(?:-[0-9a-f]+-\d+)?/", 1)
    when = F.when(batch != "", batch.cast("bigint")).otherwise(F.unix_micros("modificationTime"))
    order = Window.orderBy(when, F.regexp_replace("path", r"\.1$", ""), F.when(F.col("path").endswith(".1"), 0).otherwise(1))
    before = F.sum(F.col("length") + F.lit(_ROW_IN_PARTITION + 1)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return files.select(_plain(F.col("path")).alias("__file"), F.coalesce(before, F.lit(0)).alias("__first"))


def _with_order(df: DataFrame, path: str) -> DataFrame:
    """``seq`` in append order: file, then place in the file.

    A row's place is the start of its split plus its index among the rows read by the
    task.  A row takes at least two bytes, so the index never reaches the next split.
    """
    index = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_PARTITION))
    placed = df.select(*df.columns, _plain(F.col("_metadata.file_path")).alias("__file"), (F.col("_metadata.file_block_start") + index).alias("__place"))
    ranged = placed.join(_file_ranges(df.sparkSession, path), "__file")
    return ranged.withColumn("seq", F.col("__first") + F.col("__place")).drop("__file", "__first", "__place")


def _read(spark: SparkSession, path: str, schema: T.StructType, mode: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("seq", F.lit(0).cast("bigint"))
    reader = spark.read.schema(schema).option("mode", mode).option("recursiveFileLookup", True)
    return _with_order(reader.json(path), path)


def _required(df: DataFrame, names: list[str]) -> DataFrame:
    return df.dropna(subset=names)


def read_transcripts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Turns.  Strict: a bad line fails the job.  Lenient: it is dropped."""
    df = _read(spark, path, schemas.TURN, "FAILFAST" if strict else "DROPMALFORMED")
    needed = ["schema_version", "timestamp", "session_id", "role", "content"]
    if strict:
        missing = F.raise_error(F.lit("a transcript line lacks a required field"))
        present = F.lit(True)
        for name in needed:
            present = present & F.col(name).isNotNull()
        df = df.where(F.when(present, True).otherwise(missing.cast("boolean")))
    else:
        df = _required(df, needed)
    none = lambda field: F.array().cast(field.dataType)
    return df.withColumns(
        {f.name: F.coalesce(f.name, none(f)) for f in schemas.TURN.fields if f.name in ("lint", "receipts")}
    )


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path, schemas.COST, "DROPMALFORMED")
    df = _required(df, ["schema_version", "provider", "model", "usage"])
    return df.withColumn("provider", provider_name(F.col("provider")))


def read_health(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path, schemas.HEALTH, "DROPMALFORMED")
    df = _required(df, ["schema_version", "provider", "model"])
    counters = {c: F.coalesce(c, F.lit(0)) for c in schemas.HEALTH_COUNTERS}
    return df.withColumns(counters).withColumn("provider", provider_name(F.col("provider")))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Outcome labels; the last entry of a session wins."""
    reader = spark.read.schema(schemas.LABEL).option("multiLine", True).option("recursiveFileLookup", True)
    rows = _with_order(reader.option("mode", "FAILFAST").json(path), path)
    last = rows.groupBy("session_id").agg(
        F.max(F.struct("seq", "completed", "correct")).alias("l")
    )
    return last.select("session_id", "l.completed", "l.correct")


def read_served(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path, schemas.SERVED, "DROPMALFORMED")
    return df.where(F.col("digest").rlike(DIGEST))


def read_transform_receipts(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path, schemas.TRANSFORM_RECEIPT, "DROPMALFORMED")
    return df.where(F.col("digest").rlike(DIGEST))


def read_eval_corpus(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.EVAL_CORPUS).option("multiLine", True).json(path)
    return raw.select("corpus_version", F.inline("tasks"))


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.EVAL_CASES).option("multiLine", True).json(path)
    return raw.select(F.inline("cases")).withColumnRenamed("id", "case_id")


def pricing_dim(spark: SparkSession, prices: dict[str, dict[str, float]]) -> DataFrame:
    """A pricing table from ``{provider: {input_per_million_usd: …, …}}``."""
    names = schemas.PRICING.fieldNames()[1:]
    rows = [(provider, *[price.get(n) for n in names]) for provider, price in sorted(prices.items())]
    return spark.createDataFrame(rows, schemas.PRICING)


def append_folder(path: str) -> str:
    """The folder of an append that starts now."""
    return f"{path.rstrip('/')}/{_BATCH}{time.time_ns() // 1000:020d}"


def ledger_checkpoint(spark: SparkSession, path: str) -> str:
    """Where a stream into the ledger at ``path`` keeps its progress."""
    return f"{shared_dir(spark)}/ledger-{_stream_name(path)}"


def _stream_name(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:16]


def _batch_folder(spark: SparkSession, path: str, number: int) -> str:
    """The folder of a stream's batch: the one it had before, or one that starts now."""
    name = f"{_stream_name(path)}-{number}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{_BATCH}*-{name}")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found[0].getPath().toString() if found else f"{append_folder(path)}-{name}"


def append_ledger(df: DataFrame, path: str, fmt: str = "json") -> StreamingQuery | None:
    """Append rows to a ledger; a streaming frame appends through a checkpointed sink.

    Each append is a folder of its own, named by its time, so readers see appends in their
    order and the rows of one append in the order of its partitions.  The checkpoint of a
    stream belongs to the ledger, so a restarted query goes on where it stopped.
    """
    if not df.isStreaming:
        df.write.format(fmt).save(append_folder(path))
        return None
    return (
        df.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", ledger_checkpoint(df.sparkSession, path))
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )


def stream_ledger(df: DataFrame, path: str, fmt: str = "json") -> StreamingQuery:
    """Append a stream's micro-batches to a ledger that other writers append to as well.

    A batch is a folder like any other append and is found by the batch's number: one that runs
    again, after a crash or from an older checkpoint, overwrites itself and keeps its place in
    the order.  The checkpoint belongs to the ledger.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.format(fmt).mode("overwrite").save(_batch_folder(batch.sparkSession, path, number))

    return df.writeStream.foreachBatch(store).option("checkpointLocation", ledger_checkpoint(df.sparkSession, path)).trigger(availableNow=True).start()


def read_response_chunks(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream response chunks from JSON files; the assembler splits them into records.

    ``data`` holds raw bytes (Base64 in the files), since a chunk may end inside a character.
    """
    reader = spark.readStream.schema(schemas.CHUNK).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("recursiveFileLookup", True).json(path)
