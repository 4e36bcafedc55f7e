"""Checked CSV, runs in one table, statistics of one's own, merging in buckets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType

from chronopanel import Limits, Stage, generate_features
from chronopanel.operators import metrics
from chronopanel.operators.asof import latest_mark
from chronopanel.operators.frozen import freeze
from chronopanel.operators.snapshot import OWN_STATISTICS, register_statistic
from chronopanel.plans.generate import merge_stored
from chronopanel.plans.spec import OPERATORS, Operator, register
from chronopanel.sources import logs, tables

SCHEMA = StructType([StructField("id", LongType(), False), StructField("a b", DoubleType()), StructField("day", DateType())])


def test_rejects(spark, tmp_path):
    lines = ["1,2.5,2017-01-01", '2,"3",', "x,4,2017-01-01", "3,?,soon", ",1,2017-01-02", "4", "5,1,2017-01-01,more", '"6","a,b",2017-01-01', "", "7,,"]
    (tmp_path / "a.csv").write_text("\n".join(["id,a b,day", *lines[:5]]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(["id,a b,day", *lines[5:]]) + "\n")
    good, rejects = tables.ingest_checked(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], str(tmp_path / "t"), SCHEMA)
    assert good.columns == ["id", "a b", "day"]
    assert sorted(map(tuple, good.collect()), key=str) == [(1, 2.5, dt.date(2017, 1, 1)), (2, 3.0, None), (7, None, None)]
    found = {r["record"]: (r["file"].rsplit("/", 1)[1], r["problems"]) for r in rejects.collect()}
    assert found == {
        "x,4,2017-01-01": ("a.csv", ["id: unreadable"]),
        "3,?,soon": ("a.csv", ["a b: unreadable", "day: unreadable"]),
        ",1.0,2017-01-02": ("a.csv", ["id: missing"]),
        "4": ("b.csv", ["fields"]),
        "5,1,2017-01-01,more": ("b.csv", ["fields"]),
        '"6","a,b",2017-01-01': ("b.csv", ["a b: unreadable"]),
    }


def test_header_of_other_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,c,day\n1,2,2017-01-01\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.ingest_checked(spark, str(tmp_path / "a.csv"), str(tmp_path / "t"), SCHEMA)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("limits", [Limits(), Limits(rows_per_group=5, broadcast_cells=1)])
def test_latest_mark(spark, keys, limits):
    """Also a time and a key that most rows share, marks at one time, rows before any mark and nulls."""
    draw = random.Random(1)
    rows = [(i, draw.choice(["a", "a", "a", "b", "c", None]), draw.choice([50, draw.randrange(100), None])) for i in range(400)]
    marks = [(draw.choice(["a", "b", "d", None]), draw.choice([50, draw.randrange(5, 100), None]), f"m{i}") for i in range(40)]
    found = latest_mark(
        spark.createDataFrame(rows, "i long, k string, t long").repartition(4), spark.createDataFrame(marks, "k string, t long, m string"),
        keys, "t", ["m"], limits,
    )
    want = {}
    for i, k, t in rows:
        fit = [(u, m) for c, u, m in marks if t is not None and u is not None and u <= t and (not keys or (c is not None and c == k))]
        want[i] = max(fit)[1] if fit else None
    assert {r["i"]: r["m"] for r in found.collect()} == want and found.columns == ["i", "k", "t", "m"]
    empty = latest_mark(found.select("i", "k", "t"), spark.createDataFrame([], "k string, t long, m string"), keys, "t", ["m"], limits)
    assert empty.where("m IS NOT NULL").count() == 0 and empty.count() == 400


def test_several_logs(spark, tmp_path):
    (tmp_path / "one.log").write_text("___HEARTBEAT___:5000000000,1\nother\n___HEARTBEAT___:7000000000,2\n")
    (tmp_path / "two.log").write_text("___HEARTBEAT___:9000000000,1\n")
    beats = logs.heartbeats_in(logs.read_lines(spark, str(tmp_path))).withColumn("run", F.regexp_extract("file", r"([^/]+)\.log", 1))
    curve = metrics.step_curve(beats.select("run", "time", "heartbeat"), ["run"]).where("part = 2")
    assert sorted((r["run"], r["x"], r["y"]) for r in curve.collect()) == [("one", 0.0, 1), ("one", 2.0, 2), ("two", 0.0, 1)]
    samples = spark.createDataFrame([("heap.used,pid=1", t, float(t)) for t in (4000, 5000, 8999, 9000)], "key string, epoch_ms long, value double")
    found = metrics.run_series(samples, metrics.run_origins(beats)).orderBy("value").collect()
    assert [(r["run"], r["x"]) for r in found] == [(None, None), ("one", 0.0), ("one", 3.999), ("two", 0.0)]


@pytest.fixture
def own(monkeypatch):
    monkeypatch.setattr("chronopanel.operators.snapshot.OWN_STATISTICS", OWN_STATISTICS)
    register_statistic("test_range", lambda panel, v: f"max({v}) - min({v})")
    register("Test_scaled", Operator("distance", "S_", statistic="min", unit="test_range"))
    yield
    del OWN_STATISTICS["test_range"], OPERATORS["Test_scaled"]


def test_own_statistic(golden, panel, own):
    out = generate_features(golden, panel, {"x": [Stage("Test_scaled"), Stage("Ts_lags", "S_")]})
    found = {(r["ID"], r["t"]): r["S_x"] for r in out.collect()}
    first, second, third = dt.date(2017, 1, 1), dt.date(2017, 1, 31), dt.date(2017, 3, 2)
    assert [found[e, first] for e in "abc"] == [0.0, 1.0, 1.0] and found["b", second] is None
    assert found["a", third] is None  # all values are equal: no unit
    reference = freeze(golden.where(F.col("t") == F.lit(first)), panel, ["x"])
    frozen = generate_features(golden, panel, {"x": [Stage("Test_scaled")]}, reference=reference)
    assert {(r["ID"], r["t"]): r["S_x"] for r in frozen.collect()}["c", second] == 2.0


def test_unknown_statistics(own):
    with pytest.raises(ValueError, match="unknown statistics"):
        register("Test_other", Operator("distance", statistic="none_such"))
    with pytest.raises(ValueError, match="no name"):
        register_statistic("mean", lambda panel, v: v)


def test_merge_in_buckets(spark, golden, panel, tmp_path):
    def save(name, df, buckets=3):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        tables.save_by_entity(df, name, panel, buckets, str(tmp_path / name))

    save("keys_", golden.select("t", "ID"))
    save("one_", golden.select("t", "ID", F.col("x").alias("x1")))
    save("two_", golden.where("x > 1").select("t", "ID", (F.col("x") * 2).alias("x2")))
    merged = merge_stored(spark, "keys_", ["one_", "two_"], panel)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    want = {(r["ID"], r["t"]): (r["x"], r["x"] * 2 if r["x"] and r["x"] > 1 else None) for r in golden.collect()}
    assert {(r["ID"], r["t"]): (r["x1"], r["x2"]) for r in merged.collect()} == want
    save("two_", golden.select("t", "ID", F.col("x").alias("x2")), 4)
    with pytest.raises(ValueError, match="buckets"):
        merge_stored(spark, "keys_", ["two_"], panel)
    save("two_", golden.union(golden).select("t", "ID", F.col("x").alias("x2")))
    with pytest.raises(ValueError, match="more than once"):
        merge_stored(spark, "keys_", ["two_"], panel)
    save("two_", golden)
    save("one_", golden)
    with pytest.raises(ValueError, match="both tables"):
        merge_stored(spark, "one_", ["two_"], panel)
