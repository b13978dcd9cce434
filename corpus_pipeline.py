"""From raw documents to packed sequences: each stage works on all that the one before kept.

Toxic documents go, of equal texts one stays, of each group of near copies one stays, personal
values get pseudonyms, and what is left is packed.  Every stage but the last returns the columns
of ``documents``; each is written to the shared folder and read again, so a lost executor costs
tasks of one stage only.  Empty tables, NULL texts, repeated rows and extra columns pass as the
operators say.

Rows go to Python in Arrow batches of at most 4 MB, unless the session says otherwise: by number of
rows alone, a batch of texts takes tens of megabytes, several times over in the executor and its workers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlytics.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from convlytics.llm.common import cut
from convlytics.llm.queries import PSEUDONYM_KEY


_BATCH_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # Set for good: the stage's result runs when it is written, after this function.
        if spark.conf.get(_BATCH_BYTES, None) is None:
            spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_in_small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without blanks, the longest with the smallest id."""
    return exact_dedup.without_copies(docs)


@_in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 over five words, the smallest id."""
    return jaccard_join.one_of_each(docs, words=5, percent=80)


@_in_small_batches
def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced by pseudonyms; ``n_chars`` follows the new text."""
    hidden = pii.pseudonymise(docs, PSEUDONYM_KEY, count_col="__n_replaced").drop("__n_replaced")
    if "n_chars" not in docs.columns:
        return hidden
    return hidden.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


@_in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4,096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), added_tokens=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("pii", hide_persons),
    ("packing", pack),
]

#: Trees, pseudonyms and packing can't be said in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
