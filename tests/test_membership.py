import pytest
from pyspark.sql import functions as F

from convlytics.plans import membership


@pytest.mark.parametrize("bits", [1 << 16, membership.BITS])
def test_anti_join_and_one_of_each(spark, bits):
    rows = spark.range(3000).select(F.when(F.col("id") % 100 != 0, F.concat(F.lit("k"), F.col("id") % 700)).alias("key"), "id").repartition(3)
    members = spark.range(0, 900, 3).select(F.concat(F.lit("k"), "id").alias("key"))
    for some in (members, members.limit(0)):
        want = sorted(r.id for r in rows.join(some, "key", "left_anti").collect())
        assert sorted(r.id for r in membership.without(rows, "key", some, bits).collect()) == want
    once = membership.one_of_each(rows, "key", bits).collect()
    assert len(once) == len({r.key for r in once}) == rows.select("key").distinct().count()
    single = spark.range(50).select("id", F.col("id").cast("string").alias("key"))
    assert membership.one_of_each(single, "key", bits).count() == 50


def test_the_filter_spares_most_rows(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("key"), F.lit("wide").alias("bytes"))
    members = spark.range(100).select(F.col("id").cast("string").alias("key"))
    maybe, never = membership.split_by_filter(rows, "key", members)
    assert 100 <= maybe.count() <= 110 and maybe.count() + never.count() == 20_000
