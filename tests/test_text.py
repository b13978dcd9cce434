from frame_values import values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convlytics.functions import text as tx
from convlytics.functions.stats import held_out, pearson


def rust_like_lines(text):
    if text == "":
        return []
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
        return [p.removesuffix("\r") for p in parts]
    return [p.removesuffix("\r") for p in parts[:-1]] + [parts[-1]]


ALPHABET = st.text(alphabet=" \t\r\nab-|.`é ", max_size=14)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(samples=st.lists(ALPHABET, min_size=40, max_size=60))
def test_lines_trim_and_blank(texts, samples):
    df = texts(samples).select(
        "id",
        tx.lines(F.col("text")).alias("lines"),
        tx.trim(F.col("text")).alias("trim"),
        tx.trim_end(F.col("text")).alias("trim_end"),
        tx.is_blank(F.col("text")).alias("blank"),
    )
    for row, sample in zip(df.orderBy("id").collect(), samples):
        assert row.lines == rust_like_lines(sample), repr(sample)
        assert row.trim == sample.strip()
        assert row.trim_end == sample.rstrip()
        assert row.blank == (sample.strip() == "")


def test_words_keep_long_cores(texts):
    df = texts(["Hello, (World)! it's a-b ab é1é", "--- ...", "naïve `code` x2y"])
    got = values(df.select("id", tx.words(F.col("text")).alias("w")), "w")
    assert got == [["hello", "world", "it's", "a-b", "é1é"], [], ["naïve", "code", "x2y"]]


def test_json_check_rejects_what_follows(texts):
    good = ['{"a":1,"a":2}', "[1,[2]]", "{}", '[{"k":"v"}]', "{ }"]
    bad = ['{"a":1} x', "{a:1}", "[1],[2]", "[[1]] [", "{}} {", "{'a':1}", "[NaN]", "[1", "{} {}"]
    got = values(texts(good + bad).select("id", tx.is_json(F.col("text")).alias("j")), "j")
    assert got == [True] * len(good) + [False] * len(bad)


def test_held_out_matches_fnv(texts):
    ids = ["", "a", "s1", "session-é", "0" * 40] + [f"id{i}" for i in range(200)]

    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return h % 5 == 0

    got = values(texts(ids).select("id", held_out(F.col("text")).alias("h")), "h")
    assert got == [fnv(s) for s in ids]


def test_pearson_is_null_without_variance(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (2, 2.0, 4.0), (3, 1.0, 1.0)], "g int, x double, y double")
    got = {r.g: r.r for r in df.groupBy("g").agg(pearson(F.col("x"), F.col("y")).alias("r")).collect()}
    assert got[1] is None and got[3] is None and abs(got[2] - 1.0) < 1e-12
