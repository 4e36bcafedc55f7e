import datetime as dt

import pytest
from chronopanel import Panel, Stage, generate_features
from chronopanel.operators.history import moving_sql
from chronopanel.operators.pieces import CrossSection
from chronopanel.operators.snapshot import snapshot_stats
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F


def test_totals_beyond_64_bits(spark):
    """1000 values of 10^14 with two decimals add up to 10^19 units."""
    panel = Panel("ID", "t", exact_scale=2)
    df = spark.range(1000).selectExpr("cast(id AS string) AS ID", "date'2020-01-01' AS t", "1e14D + id % 2 AS x")
    found = snapshot_stats(CrossSection(df, panel), [("x", "mean")]).first()
    assert found["__mean_x"] == 1e14 + 0.5
    wide = generate_features(df, panel, {"x": [Stage("Cs_distanceFromMean")]})
    assert sorted({r["DM_x"] for r in wide.collect()}) == [-0.5, 0.5]
    assert wide.first()["t"] == dt.date(2020, 1, 1)


def test_moving_means_add_longs(spark):
    """Seven values of up to 18 digits are added exactly without decimals; more digits are refused as in all exact sums."""
    panel, stages = Panel("ID", "t", exact_scale=2), {"x": [Stage("Ts_distanceFromMovingAverages")]}
    for value in (0.01, 0.07, 9e15, -9e15):
        df = spark.range(7).selectExpr("'a' AS ID", "date_add(date'2020-01-01', int(id)) AS t", f"{value!r}D AS x")
        wide = generate_features(df, panel, stages)
        assert wide.where("t = date'2020-01-07'").first()["DMM_x_6"] == pytest.approx(0.0, abs=1e-16)
    assert "AS DECIMAL(18, 0)), 0)" not in moving_sql(panel, "x", "mean", 6) and "AS BIGINT) ELSE" in moving_sql(panel, "x", "mean", 6)
    over = generate_features(df.withColumn("x", F.lit(1e17)), panel, stages)
    with pytest.raises(ArithmeticException):
        over.collect()
