"""Appended snapshots, frozen cross-sections, schemes, controllers in tables and sketches."""

import datetime as dt
import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from chronopanel import FULL, KEEP, Limits, Panel, Stage, generate_features, shipped_controller
from chronopanel.functions.text import row_hash
from chronopanel.ml import FrozenPanel, as_json
from chronopanel.operators.frozen import Reference, freeze
from chronopanel.operators.scoretable import score_table, scores_by_scheme
from chronopanel.operators.sketches import merged, quantiles, rank_error, sketched
from chronopanel.plans.config import check_controller, controller_from_table, controller_table
from chronopanel.plans.store import FeatureStore

TINY = Limits(rows_per_group=4)
RECIPES = {"x": FULL, "y": [Stage("Cs_distanceFromMean"), Stage("Ts_lags"), Stage("Ts_lags", "DM_")], "z": KEEP}


def day(i):
    return dt.date(2017, 1, 1) + dt.timedelta(30 * i)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    return [
        (f"e{e}", day(i), draw.choice([None, float("nan"), 1.0, 2.5, draw.randrange(9) / 4]), float(draw.randrange(50)), "kept" and float(e))
        for e in range(12)
        for i in range(11)
        if draw.random() < 0.8
    ]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "ID string, t date, x double, y double, z double").repartition(3)


def collected(df):
    return sorted((tuple(df.columns), repr([None if v != v else v for v in r])) for r in df.collect())


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_appending_equals_one_run(spark, df, panel, tmp_path, limits):
    """Snapshots one by one or several at once, with gaps in the entities' calendars, and as hot entities."""
    store = FeatureStore(spark, str(tmp_path / "s"), panel, RECIPES, limits=limits)
    for low, high in ((0, 1), (1, 4), (4, 5), (5, 5), (5, 11)):
        store.append(df.where((F.col("t") >= F.lit(day(low))) & (F.col("t") < F.lit(day(high)))))
    whole = generate_features(df, panel, RECIPES)
    got = store.features().select(*whole.columns)
    assert collected(got) == collected(whole) and whole.columns[:2] == ["t", "ID"]


def test_an_append_can_be_repeated_with_corrected_rows(spark, df, panel, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"), panel, RECIPES)
    store.append(df.where(F.col("t") < F.lit(day(6))))
    late = df.where(F.col("t") == F.lit(day(6)))
    store.append(late.withColumn("y", F.col("y") + 100))
    store.append(late)
    store.append(df.where(F.col("t") > F.lit(day(6))))
    whole = generate_features(df, panel, RECIPES)
    assert collected(store.features().select(*whole.columns)) == collected(whole)


def test_an_append_reads_only_its_rows_and_the_tail(spark, df, panel, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"), panel, RECIPES)
    store.append(df.where(F.col("t") < F.lit(day(9))))
    tail = store._tail_before(day(9))
    assert set(tail.columns) == {"ID", "t", "x", "y", "DM_x", "DM_y"} and tail.groupBy("ID").count().agg(F.max("count")).first()[0] == 6
    new = df.where(F.col("t") >= F.lit(day(9)))
    files = store._generated(new, tail).inputFiles()
    assert not [f for f in files if "/features/" in f] and [f for f in files if "/tails/" in f]


def test_frozen_ranks_and_distances(spark, df, rows, panel):
    known = lambda v: v is not None and v == v
    kept, later = [r for r in rows if r[1] < day(3)], [r for r in rows if r[1] >= day(3)]
    recipe = FULL[:5]
    for limits in (Limits(), TINY):
        reference = freeze(df.where(F.col("t") < F.lit(day(3))), panel, ["x", "y"], limits)
        got = generate_features(df.where(F.col("t") >= F.lit(day(3))), panel, {"x": recipe, "y": recipe}, KEEP, limits, reference=reference)
        found = {(r["ID"], r["t"]): r.asDict() for r in got.collect()}
        assert len(found) == len(later)
        for r in later:
            for name, i in (("x", 2), ("y", 3)):
                values = sorted(k[i] for k in kept if known(k[i]))
                own, out = r[i], found[r[0], r[1]]
                assert out[f"E_{name}"] == (sum(v <= own for v in values) / len(kept) if known(own) else 0.0)
                if known(own):
                    half = len(values) // 2
                    median = values[half] if len(values) % 2 else (values[half - 1] + values[half]) / 2
                    assert out[f"DM_{name}"] == pytest.approx(own - sum(values) / len(values))
                    assert (out[f"DMI_{name}"], out[f"DMA_{name}"], out[f"DME_{name}"]) == (own - values[0], own - values[-1], own - median)
                else:
                    assert out[f"DM_{name}"] is None


def test_frozen_panel_is_an_estimator_that_can_be_stored(spark, df, tmp_path):
    estimator = FrozenPanel(recipe=as_json(FULL[:8]), inputCols=["x", "y"], snapshotCol="t", path=str(tmp_path / "reference"))
    model = Pipeline(stages=[estimator]).fit(df.where(F.col("t") == F.lit(day(0))))
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    later = df.where(F.col("t") > F.lit(day(0)))
    one, two = model.transform(later), again.transform(later)
    assert one.columns[:5] == df.columns and {"E_x", "B4_E_x", "Q_E_y", "2SDU_Q_E_y"} <= set(one.columns)
    assert collected(one) == collected(two)


def test_frozen_sections_know_their_columns(spark, df, panel, tmp_path):
    reference = freeze(df, panel, ["x"])
    with pytest.raises(ValueError, match="no column y"):
        generate_features(df, panel, {"y": FULL[:5]}, KEEP, reference=reference)
    with pytest.raises(ValueError, match="no rows"):
        freeze(df.limit(0), panel, ["x"])
    reference.save(str(tmp_path))
    assert Reference.load(spark, str(tmp_path)).statistics == reference.statistics


@pytest.mark.parametrize("limits", [Limits(), Limits(rows_per_group=2, broadcast_cells=1)])
def test_schemes(spark, limits):
    outputs = spark.createDataFrame(
        [(i, "d", "m" if i < 6 else "k", p, ["a", "b", "none", None][i % 4], "b") for i, p in enumerate([0.0, 0.1, 0.25, 0.5, None, float("nan"), 0.9, 1.0])],
        "id long, day string, model string, p double, s string, q string",
    )
    schemes = spark.createDataFrame([("a", 50.0), ("a", 20.0), ("b", 0.25), ("b", 0.5), ("b", 0.5), ("b", None), ("c", 1.0)], "scheme_id string, border double")
    found = {r["id"]: r.asDict() for r in scores_by_scheme(outputs, schemes, "id", "day", ["model"], "p", "s", "q", limits).collect()}
    plain = {r["id"]: r["score"] for r in score_table(outputs, "id", "day", ["model"], "p").collect()}
    borders = {"a": [20.0, 50.0], "b": [0.25, 0.5]}
    for i, r in found.items():
        assert r["score"] == plain[i] and (r["score_bucketing_scheme_id"], r["probability_bucketing_scheme_id"]) == (["a", "b", "none", None][i % 4], "b")
        for value, scheme, bucket in ((r["score"], r["score_bucketing_scheme_id"], r["score_bucket"]), (r["probability"], "b", r["probability_bucket"])):
            known = value is not None and value == value and scheme in borders
            assert bucket == (float(sum(b <= value for b in borders[scheme])) if known else None)
    assert len(found) == 8


def test_controller_tables(spark):
    shipped = shipped_controller()
    again = controller_from_table(controller_table(spark, shipped).repartition(5))
    assert again == {c: tuple(r) for c, r in shipped.items()}
    check_controller(["id", "t", *shipped], Panel("id", "t"), again)
    with pytest.raises(ValueError, match="more than 3"):
        controller_from_table(controller_table(spark, shipped), most=3)
    twice = spark.createDataFrame([("a", 1, "Cs_ecdf", "", None), ("a", 1, "Cs_ecdf", None, None)], "column string, stage int, operator string, source string, prefix string")
    with pytest.raises(ValueError, match="two stages 1"):
        controller_from_table(twice)
    with pytest.raises(ValueError, match="needs column"):
        controller_from_table(twice.withColumn("operator", F.lit(None).cast("string")))


def test_controllers_are_checked_before_any_job():
    bad = {
        "gone": KEEP,
        "a": (Stage("Cs_nothing"), Stage("Cs_ecdf"), Stage("Cs_distanceFromMean", "", "E_"), Stage("Cs_bucketize", "Q_E_")),
        "b": (Stage("Cs_distanceFromMean", "Y_", "X_"), Stage("Cs_distanceFromMin", "X_", "Y_")),
        "c": (Stage("Cs_distanceFromMean", "", "k_"),),
    }
    with pytest.raises(ValueError) as found:
        check_controller(["ID", "snapshotDate", "a", "b", "c", "k_c"], Panel(), bad)
    text = str(found.value)
    for part in ("no column gone", "unknown operator Cs_nothing", "makes E_a", "needs Q_E_a, which is made by no stage", "needs Y_b, which is made only by stages that wait", "makes k_c, which the table has"):
        assert part in text


def test_sketches(spark, panel):
    draw = random.Random(5)
    rows = [(f"e{i}", day(i % 4), draw.choice([None, float("nan"), draw.gauss(0, 9)])) for i in range(9000)]
    df = spark.createDataFrame(rows, "ID string, t date, x double").repartition(7)
    daily = sketched(df, Panel("ID", "t"), [F.col("t")], ["x"])
    whole = merged(daily, [F.lit(1).alias("all")], ["x"])
    values = sorted(x for _, _, x in rows if x is not None and x == x)
    for r in quantiles(whole, "x", [0.05, 0.5, 0.95]).collect():
        rank = sum(v <= r["quantile"] for v in values) / len(values)
        assert r["n_x"] == len(values) and abs(rank - r["share"]) <= 2 * rank_error()
    none = df.where("x IS NULL").limit(3)
    assert [(r["n_x"], r["quantile"]) for r in quantiles(sketched(none, panel, [F.lit(1).alias("all")], ["x"]), "x", [0.5]).collect()] == [(0, None)]
    assert rank_error(800) < rank_error(400) < 0.011


def test_row_hash_tells_where_nulls_are(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", "b"), (None, None)], "x string, y string")
    assert len({r[0] for r in df.select(row_hash(F.col("x"), F.col("y"))).collect()}) == 4
