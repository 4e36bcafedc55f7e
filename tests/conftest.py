import datetime as dt

import pytest
from pyspark.sql import SparkSession

from chronopanel import Limits, Panel, configure


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return configure(session)


@pytest.fixture(scope="session")
def panel():
    return Panel("ID", "t")


# Small enough that every fixture has hot snapshots and hot entities.
TINY = Limits(rows_per_group=4)


@pytest.fixture(scope="session")
def golden(spark):
    d = dt.date
    rows = [
        ("a", d(2017, 1, 1), 1.0),
        ("a", d(2017, 1, 31), 2.0),
        ("a", d(2017, 3, 2), 4.0),
        ("b", d(2017, 1, 1), 3.0),
        ("b", d(2017, 1, 31), None),
        ("b", d(2017, 3, 2), 4.0),
        ("c", d(2017, 1, 1), 3.0),
        ("c", d(2017, 1, 31), 5.0),
        ("d", d(2017, 4, 1), 7.0),
    ]
    return spark.createDataFrame(rows, "ID string, t date, x double").repartition(3)
