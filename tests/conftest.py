import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from convlytics.plans.packaging import ship_package
    from convlytics.plans.storage import use_folder_if_unset

    use_folder_if_unset(session, str(tmp_path_factory.mktemp("shared")))

    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """A frame of numbered texts in one column."""

    def make(values, column="text"):
        return spark.createDataFrame(list(enumerate(values)), f"id bigint, {column} string")

    return make
