import pytest
from pyspark.sql import functions as F

#: Columns that operators use inside or return: they must not disturb an input that has them too.
CLASHES = "n kept keep_id group_size score predicted tokens found body owner rows points best dim shard id family label own shared token sig probability prediction rawPrediction features fold toxic term text_sha256 n_replaced start length sequence_id component_id leaf claimed position leaves partition way subroot root proof size key pattern words members taken cuts ends".split()

LONG = " ".join(f"w{i % 977} filler{i % 13}" for i in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "the QUICK  brown fox\tjumps over the lazy dog\nnear the river bank today"),
    (3, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (3, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (4, None),
    (5, ""),
    (6, " \t\n\x0b\x0c\r "),
    (7, "one"),
    (8, "one"),
    (9, LONG),
    (10, LONG + " end"),
    (None, "one"),
    (None, None),
    (11, "žluťoučký kůň 日本 🙂 é \x1c\x85\xa0 x"),
    (12, "Licensed under the Apache License, Version 2.0."),
    (13, "reach me: und.34@mail7.example.com +1 (017) 555-7713, 97.51.17.173; 4539148803436467!"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """NULLs in every column, empty and long texts, ties, repeated rows and clashing names."""
    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    frame = frame.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    return frame.withColumns({c: F.lit("x") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
