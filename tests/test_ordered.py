"""The blocked scans must equal plain windows, also when one key holds most rows."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from convlytics.plans.ordered import Nearest, carry, lower_median, number_rows, running_sum, with_halo


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for seq in range(600):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}"
        rows.append((key if rng.random() > 0.02 else None, seq * 3, rng.choice([None, 1, 2, 5])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, seq bigint, v bigint").cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_sum(skewed, keys):
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    got = running_sum(skewed, keys, "seq", {"s": F.col("v"), "n": F.lit(1)}, span=50)
    want = skewed.withColumn("s", F.sum(F.coalesce("v", F.lit(0))).over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    same(got, want)


def test_number_rows(skewed):
    w = Window.partitionBy("k").orderBy("seq")
    same(number_rows(skewed, ["k"], "seq", "p", span=64), skewed.withColumn("p", F.row_number().over(w)))


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("forward", [True, False])
def test_carry(skewed, inclusive, forward):
    order = F.col("seq").desc() if forward else F.col("seq")
    w = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    got = carry(skewed, ["k"], "seq", {"c": Nearest(F.col("v"), inclusive, forward)}, span=40)
    same(got, skewed.withColumn("c", F.last("v", ignorenulls=True).over(w)))


def test_halo_keeps_frames_whole(skewed):
    placed = number_rows(skewed, ["k"], "seq", "p", span=64)
    w = Window.partitionBy("k").orderBy("p").rowsBetween(-5, -1)
    want = placed.withColumn("n", F.sum(F.coalesce("v", F.lit(0))).over(w))
    blocks = with_halo(placed, "p", 5, "b", "own", rows=16)
    assert blocks.groupBy("k", "b").count().agg(F.max("count")).first()[0] <= 21
    wb = Window.partitionBy("k", "b").orderBy("p").rowsBetween(-5, -1)
    got = blocks.withColumn("n", F.sum(F.coalesce("v", F.lit(0))).over(wb)).where("own").drop("b", "own")
    same(got, want)


def test_lower_median(spark):
    rng = random.Random(3)
    data = {"a": [0.5], "b": [0.0, 0.0, 1.0, 7.0], "c": [rng.choice([0.0, 0.1, 0.2, 3.5, 3.6]) for _ in range(101)], "d": [rng.random() for _ in range(50)]}
    rows = [(k, x) for k, xs in data.items() for x in xs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r.m for r in lower_median(df, ["k"], "x", "m").collect()}
    assert got == {k: sorted(xs)[(len(xs) - 1) // 2] for k, xs in data.items()}
    everything = sorted(x for _, x in rows)
    assert lower_median(df, [], "x", "m").first().m == everything[(len(everything) - 1) // 2]


def test_no_window_over_a_whole_key(skewed):
    """Windows are partitioned by the block, or run over one row per block."""
    for df in (running_sum(skewed, ["k"], "seq", {"s": F.col("v")}), carry(skewed, ["k"], "seq", {"c": Nearest(F.col("v"))})):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows
        for line in windows:
            specs = re.findall(r"\[[^\[\]]*\]", line)
            assert any("__block" in spec for spec in specs[-2:]), line


def test_the_input_is_read_once(spark, skewed, tmp_path):
    skewed.write.parquet(str(tmp_path / "t"))
    df = number_rows(spark.read.parquet(str(tmp_path / "t")), ["k"], "seq", "p")
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1


def test_columns_of_any_type_pass_through(skewed):
    wide = skewed.withColumns({"m": F.create_map(F.lit("a"), "v"), "s": F.struct("v", F.array("seq").alias("l"))})
    for frame in (running_sum(wide, ["k"], "seq", {"total": F.col("v")}, span=100), carry(wide, ["k"], "seq", {"near": Nearest(F.col("v"))}, span=100)):
        rows = frame.collect()
        assert len(rows) == wide.count() and all(r.m == {"a": r.v} and r.s.l == [r.seq] for r in rows)


def test_the_input_is_moved_once(spark):
    rows = spark.createDataFrame([("a", i, i % 3, f"t{i}") for i in range(300)], "k string, seq bigint, v bigint, text string")
    for frame in (running_sum(rows, ["k"], "seq", {"total": F.col("v")}, span=100), carry(rows, ["k"], "seq", {"near": Nearest(F.col("v"))}, span=100)):
        assert len(frame.collect()) == 300
        final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("ReusedExchange") == 1 and final.count("Scan ExistingRDD") == 1
