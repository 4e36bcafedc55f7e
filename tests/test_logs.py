import datetime as dt
import random

import pytest
from chronopanel import Panel
from chronopanel.ml import PanelStage, transformers_for
from conftest import TINY
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from chronopanel.functions.text import row_hash, trailing_count
from chronopanel.operators import expand, metrics, profile, runlog
from chronopanel.operators.scoretable import score_table
from chronopanel.plans.spec import FULL, Stage
from chronopanel.scale import DEFAULT_LIMITS, add_neighbour, rank_in_key
from chronopanel.sources import logs, tables

LOG = """\
noise
001__MEASURE__ START(whole run): 2018-04-10 10:00:00 1000.000
002__MEASURE__ START(reading 300): 2018-04-10 10:00:01 1001.250
002__MEASURE__   STOP: 2018-04-10 10:00:03 1003.500
003__MEASURE__ START(saving): 2018-04-10 10:00:04 1004.000
003__MEASURE__ STOP FAILED: 2018-04-10 10:00:05 1005.000
901__MEASURE__ START(bash): 2018-04-10 10:00.00 at epoch sec 999.123456789
901__MEASURE__ STOP: 2018-04-10 10:01.00 at epoch sec 1010.123456789
001__MEASURE__ STOP: 2018-04-10 10:00:09 1009.000
004__MEASURE__ START(never ends): 2018-04-10 10:00:10 1010.000
"""
FEATURES = """\
2018-04-10 10:00:00| Generating features for column: AGE
2018-04-10 10:00:04| Generating features for column: SEX
2018-04-10 10:00:05| Generating features for column: AGE
something else
2018-04-10 10:00:11| Generating features for column: LAST
"""
SCRIPT = r"""#!/bin/bash
SUBMIT_CONFIG_SMALL=" \
 --master yarn --deploy-mode cluster \
 --conf spark.driver.cores=3 \
 "
SUBMIT_CONFIG_LARGE=" \
 --master local \
 --num-executors 18 \
 "
SUBMIT_CONFIG=$SUBMIT_CONFIG_LARGE
"""


@pytest.mark.parametrize("limits", [DEFAULT_LIMITS, TINY], ids=["plain", "hot"])
def test_pairs(spark, tmp_path, limits):
    (tmp_path / "log.txt").write_text(LOG)
    lines = logs.read_lines(spark, str(tmp_path / "log.txt")).select("value")
    pairs = {r["tag"]: r for r in runlog.pair_measures(runlog.parse_measures(lines), limits=limits).collect()}
    seconds = {tag: None if r["seconds"] is None else float(r["seconds"]) for tag, r in pairs.items()}
    assert seconds == {"001": 9.0, "002": 2.25, "003": 0.0, "901": 11.0, "004": None}
    assert pairs["002"]["n"] == 300 and pairs["002"]["label"] == "reading 300" and pairs["003"]["n"] == 0


@pytest.mark.parametrize("limits", [DEFAULT_LIMITS, TINY], ids=["plain", "hot"])
def test_feature_timings(spark, tmp_path, limits):
    (tmp_path / "log.txt").write_text(FEATURES)
    events = runlog.parse_feature_lines(logs.read_lines(spark, str(tmp_path / "log.txt")).select("value"))
    rows = [(r["idx"], r["seconds"], r["label"]) for r in runlog.feature_timings(events, [], limits).collect()]
    assert sorted(rows) == [(1, 4.0, "AGE"), (1, 6.0, "AGE"), (2, 1.0, "SEX")]


def test_submit_options(spark, tmp_path):
    (tmp_path / "runTest").write_text(SCRIPT)
    options = runlog.submit_options(logs.read_scripts(spark, str(tmp_path / "runTest")).select("value"))
    assert {(r["key"], r["value"]) for r in options.collect()} == {("master", "local"), ("num-executors", "18")}


def sequence_rows():
    rng = random.Random(11)
    return [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 30)}", rng.randint(0, 40), i) for i in range(400)]


@pytest.mark.parametrize("limits", [DEFAULT_LIMITS, TINY], ids=["plain", "hot"])
@pytest.mark.parametrize("keys", [["k"], []], ids=["keyed", "global"])
def test_neighbours_and_ranks(spark, limits, keys):
    rows = sequence_rows()
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(6)
    order = [F.col("t"), F.col("v")]
    lines = {}
    for r in sorted(rows, key=lambda r: r[1:]):
        lines.setdefault(r[0] if keys else None, []).append(r)
    place = {r[2]: (line, i) for line in lines.values() for i, r in enumerate(line)}
    for step in (1, -1):
        got = add_neighbour(df, keys, order, {"n": "v"}, step, limits).collect()
        assert len(got) == 400
        for r in got:
            line, i = place[r["v"]]
            j = i + step
            assert r["n"] == (line[j][2] if 0 <= j < len(line) else None)
    ranks = rank_in_key(df, keys, order, "rank", unique=False, limits=limits).collect()
    assert {r["v"]: r["rank"] for r in ranks} == {v: i for v, (_, i) in place.items()}


def test_heartbeats_and_step_curve(spark, tmp_path):
    (tmp_path / "job.log").write_text("x\n___HEARTBEAT___:1000000000,1\n___HEARTBEAT___:1500999999,4\n")
    beats = logs.heartbeats_in(logs.read_lines(spark, str(tmp_path / "job.log")).select("value"))
    points = metrics.step_curve(beats).orderBy("ns", "part").collect()
    assert [(r["x"], r["y"]) for r in points] == [(0.0, 0), (0.0, 1), (0.5, 1), (0.5, 0), (0.5, 4)]
    (tmp_path / "beats.csv").write_text("time,heartbeat\n1000000000,1\n1500999999,4\n")
    assert logs.read_heartbeats(spark, str(tmp_path / "beats.csv")).exceptAll(beats).count() == 0


def test_step_curve_by_key(spark):
    df = spark.createDataFrame([("a", 5_000_000, 2), ("a", 7_000_000, 3), ("b", 9_000_000, 1)], "k string, time long, heartbeat long")
    for limits in (DEFAULT_LIMITS, TINY):
        points = metrics.step_curve(df, ["k"], limits=limits).orderBy("k", "ns", "part").collect()
        assert [(r["k"], r["x"], r["y"]) for r in points] == [
            ("a", 0.0, 0), ("a", 0.0, 2), ("a", 0.002, 2), ("a", 0.002, 0), ("a", 0.002, 3), ("b", 0.0, 0), ("b", 0.0, 1),
        ]


def test_metric_groups_and_series(spark, tmp_path):
    rows = [
        ("heap.used.total,pid=7,x=1", "7", dt.datetime(1970, 1, 1, 0, 0, 3), 1.0),
        ("uptime,pid=8", "8", dt.datetime(1970, 1, 1, 0, 0, 4), 2.0),
        ("cpu.trace.9,pid=7", "7", dt.datetime(1970, 1, 1, 0, 0, 4), 3.0),
    ]
    spark.createDataFrame(rows, logs.METRIC_SCHEMA).write.parquet(str(tmp_path / "m"))
    samples = logs.read_metrics(spark, str(tmp_path / "m")).withColumn("epoch_ms", F.unix_millis("time"))
    groups = {(r["group"], r["name"], r["pid"]) for r in metrics.metric_groups(samples).collect()}
    assert groups == {("heap.used", "heap.used.total", "7"), ("other.other", "uptime", "8")}
    beats = spark.createDataFrame([(1_000_000_000, 1)], logs.HEARTBEAT_SCHEMA)
    series = {(r["series"], r["x"], r["value"]) for r in metrics.aligned_series(samples, beats).collect()}
    assert series == {("heap.used.total.7", 2.0, 1.0), ("uptime.8", 3.0, 2.0)}


def test_ingest_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text('"ID","bill.amt","AGE","snapshotDate"\n"1","NA",24,"2017-01-01"\n"2","3.5",x,"2017-01-31"\n')
    raw = tables.ingest_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"))
    assert raw.columns == ["ID", "bill_amt", "AGE", "snapshotDate"] and {t for _, t in raw.dtypes} == {"string"}
    rows = tables.load_panel(spark, str(tmp_path / "out"), Panel()).orderBy("ID").collect()
    assert [tuple(r) for r in rows] == [("1", None, 24.0, dt.date(2017, 1, 1)), ("2", 3.5, None, dt.date(2017, 1, 31))]
    with pytest.raises(ValueError, match="more than once"):
        tables.without_dots(spark.createDataFrame([(1, 2)], ["a.b", "a_b"]))
    spark.createDataFrame([("1", None)], "ID string, snapshotDate string").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="null"):
        tables.load_panel(spark, str(tmp_path / "bad"), Panel())


def test_append_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], ["x", "y"])
    for _ in range(2):
        tables.append_csv(df, str(tmp_path / "c"))
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "c")).collect()] == [("1", "a")] * 2


def test_expand(spark):
    base = spark.createDataFrame([(10, 1.0), (20, 2.0), (30, 3.0)], "ID long, x double")
    out = expand.expand_table(base, "ID", copies=2, clones=2, snapshots=3, start=dt.date(2017, 1, 1)).collect()
    assert len(out) == 18
    assert sorted({r["ID"] for r in out}) == [1, 2, 3, 4, 5, 6]
    assert {r["snapshotDate"] for r in out} == {dt.date(2017, 1, 1), dt.date(2017, 1, 31), dt.date(2017, 3, 2)}
    assert all(r["x"] == r["x_1"] == r["x_2"] == float((r["ID"] - 1) % 3 + 1) for r in out)


def test_profile_and_preview(spark):
    df = spark.createDataFrame([("a", 1, 2.5), ("b", 1, None), ("a", 2, 0.5)], "ID string, t int, x double")
    rows = {r["name"]: r for r in profile.table_profile(df).collect()}
    assert rows["x"]["present"] == 2 and rows["x"]["smallest"] == "0.5" and rows["ID"]["largest"] == "b"
    latest = profile.latest_first(df, Panel("ID", "t"), 2).collect()
    assert [(r["ID"], r["t"]) for r in latest] == [("a", 2), ("a", 1)]
    plan = profile.latest_first(df, Panel("ID", "t"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_score_table(spark):
    df = spark.createDataFrame([(i, "m", i / 10) for i in range(1, 5)] + [(9, "n", 0.3)], "o int, m string, p double")
    for limits in (DEFAULT_LIMITS, TINY):
        rows = {r["o"]: r for r in score_table(df.withColumn("t", F.lit("d")), "o", "t", ["m"], "p", limits=limits).collect()}
        assert [rows[i]["score"] for i in (1, 2, 3, 4, 9)] == [25.0, 50.0, 75.0, 100.0, 100.0]
        assert rows[1]["score_bucket"] == 3.0 and rows[4]["probability_bucket"] == 5.0


def test_text_functions(spark):
    import hashlib

    row = spark.range(1).select(row_hash(F.lit("abc")).alias("h"), trailing_count(F.lit("step 12")).alias("n"), trailing_count(F.lit("step x2")).alias("z")).first()
    assert row["h"] == hashlib.sha1(b"abc").hexdigest() and row["n"] == 12 and row["z"] == 0


def test_ml_stages(spark, golden, panel, tmp_path):
    pipeline = transformers_for("x", [*FULL[:6], Stage("Ts_lags")], panel)
    model = pipeline.fit(golden)
    model.write().overwrite().save(str(tmp_path / "model"))
    out = PipelineModel.load(str(tmp_path / "model")).transform(golden)
    row = out.where("ID = 'c' and t = date'2017-01-31'").first()
    assert (row["DM_x"], row["DMI_x"], row["DME_x"], row["B4_E_x"], row["L1_x"]) == (1.5, 3.0, 1.5, 3.0, 3.0)
    renamed = PanelStage(operator="Cs_distanceFromMin", inputCol="x", outputCol="above_min", snapshotCol="t")
    assert Pipeline(stages=[renamed]).fit(golden).transform(golden).columns == ["ID", "t", "x", "above_min"]
