"""What the physical plans must and must not contain."""

import datetime as dt

import pytest
from chronopanel import FULL, KEEP, Operator, Stage, generate_features, recipe_from_table, register, shipped_controller
from chronopanel.plans.spec import OPERATORS
from pyspark.sql import functions as F

from chronopanel.ml import transformers_for
from chronopanel.operators.history import add_earlier
from chronopanel.operators.scores import add_normal_scores, bucket_columns, tail_flag_columns
from chronopanel.panel import Panel, check_keys, named
from chronopanel.sources.tables import save_by_entity


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel") / "p")
    rows = spark.range(4000).select(
        (F.col("id") % 200).alias("ID"),
        F.date_add(F.lit(dt.date(2017, 1, 1)), (F.col("id") / 200).cast("int") * 30).alias("t"),
        *[F.sin(F.col("id") + i).alias(f"c{i}") for i in range(5)],
        *[F.cos(F.col("id") + i).alias(f"k{i}") for i in range(30)],
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def test_full_recipe_plan(wide, panel):
    controller = {c: FULL if c.startswith("c") else KEEP for c in panel.value_columns(wide)}
    plan = plan_of(generate_features(wide, panel, controller))
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
    # One window for all history of all columns; the others add up totals of ranges, not rows.
    assert plan.count("Window [lag") == 1
    others = [line for line in plan.splitlines() if "Window [" in line and "Window [lag" not in line]
    assert others and all("__size" in line or "__known" in line for line in others)
    assert plan.count("SortMergeJoin") == 1
    # The rows are shuffled once, by entity, and sorted once: nothing between the join and the window.
    history = plan[plan.index("Window [lag") : plan.index("SortMergeJoin")]
    assert "Exchange" not in history and "Sort [" not in history
    assert "NestedLoop" not in plan


def test_ml_recipe_joins_no_features_back(wide, panel):
    """The whole recipe as an ML pipeline plans like the recipe itself."""
    few = wide.select("ID", "t", "c0")
    plain = plan_of(generate_features(few, panel, {"c0": FULL}))
    staged = plan_of(transformers_for("c0", FULL, panel).fit(few).transform(few))
    assert staged.count("Exchange") <= plain.count("Exchange") + 2
    assert staged.count("SortMergeJoin") == plain.count("SortMergeJoin") == 1


def test_scans_read_only_what_they_need(wide, panel):
    out = generate_features(wide, panel, {"c0": [Stage("Cs_distanceFromMean")]}, unlisted=KEEP)
    plan = plan_of(out.select("t", "ID", "DM_c0"))
    schemas = [line.split("ReadSchema:")[1] for line in plan.splitlines() if "ReadSchema:" in line]
    assert schemas and all("k1" not in s and "c1" not in s for s in schemas)


def test_bucketed_history_needs_no_shuffle(spark, wide, panel):
    save_by_entity(wide.select("ID", "t", "c0"), "by_entity", panel, 4)
    out = generate_features(spark.table("by_entity"), panel, {"c0": [Stage("Ts_lags")]})
    assert "Exchange" not in plan_of(out)
    want = generate_features(wide.select("ID", "t", "c0"), panel, {"c0": [Stage("Ts_lags")]})
    assert out.exceptAll(want).count() == 0 and out.count() == 4000


def test_bucketed_panel_is_never_shuffled(spark, wide, panel):
    save_by_entity(wide, "wide_by_entity", panel, 8)
    table = spark.table("wide_by_entity")
    controller = {c: FULL if c == "c0" else KEEP for c in panel.value_columns(table)}
    out = generate_features(table, panel, controller)
    plan = plan_of(out)
    rows_side = plan[plan.index("SortMergeJoin") :].split("Exchange")[0]
    assert "Bucketed: true" in rows_side and "k29" in rows_side
    # A mean of plain doubles depends on their order in the last digit; all else is equal.
    exact = [c for c in out.columns if c != "DM_c0" and not c.endswith("_DM_c0")]
    a, b = (df.selectExpr(*[f"`{c}`" for c in exact]) for df in (out, generate_features(wide, panel, controller)))
    assert a.exceptAll(b).count() == 0 and a.count() == 4000


def test_snapshot_filter_reads_one_folder(spark, wide, panel, tmp_path):
    from chronopanel.operators.profile import one_snapshot
    from chronopanel.sources.tables import write_features

    write_features(wide, str(tmp_path / "f"), panel)
    one = one_snapshot(spark.read.parquet(str(tmp_path / "f")), panel, dt.date(2017, 1, 31))
    assert "PartitionFilters: [isnotnull(t" in plan_of(one) and one.count() == 200


def test_result_does_not_depend_on_layout(spark, wide, panel):
    few = wide.select("ID", "t", "c0").where(F.col("ID") < 40)
    recipe = {"c0": [Stage("Cs_ecdf"), Stage("Cs_quantile", "E_"), Stage("Ts_lags"), Stage("Cs_distanceFromMedian")]}
    a = generate_features(few, panel, recipe)
    b = generate_features(few.orderBy(F.rand(5)).repartition(7), panel, recipe)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == 800


def test_properties(wide, panel):
    out = generate_features(wide.select("ID", "t", "c0"), panel, {"c0": FULL})
    bad = out.where(
        ~F.col("E_c0").between(0, 1)
        | (F.col("DMI_c0") < 0)
        | (F.col("DMA_c0") > 0)
        | (F.col("DMMI_c0_6") < 0)
        | (F.col("DMMA_c0_6") > 0)
        | (F.col("3SDU_Q_E_c0") > F.col("2SDU_Q_E_c0"))
        | (F.col("3SDD_Q_E_c0") > F.col("2SDD_Q_E_c0"))
        | ((F.col("B4_E_c0") == 5) != (F.col("B10_E_c0") == 11))
    )
    assert bad.count() == 0 and out.count() == 4000
    assert out.groupBy("t").agg(F.max("E_c0").alias("m")).where("m <> 1").count() == 0


def test_shipped_controller_shape(spark):
    controller = shipped_controller()
    assert len(controller) == 288 and sum(r is FULL for r in controller.values()) == 20
    columns = [F.lit(1.0).alias(c) for c in controller]
    df = spark.range(3).select(F.col("id").alias("ID"), *columns, F.lit(dt.date(2017, 1, 1)).alias("snapshotDate"))
    assert len(generate_features(df, Panel(), controller).columns) == 870


def test_unlisted_columns_and_unknown_names(wide, panel):
    with pytest.raises(ValueError, match="no recipe for columns c1"):
        generate_features(wide.select("ID", "t", "c0", "c1"), panel, {"c0": KEEP})
    with pytest.raises(ValueError, match="unknown operator"):
        generate_features(wide.select("ID", "t", "c0"), panel, {"c0": [Stage("nonsense")]})
    with pytest.raises(ValueError, match="no column E_c0"):
        generate_features(wide.select("ID", "t", "c0"), panel, {"c0": [Stage("Cs_quantile", "E_")]})


def test_recipe_from_table(wide, panel):
    recipe = recipe_from_table({10: ["Ts_lags", "DM_", "whatever"], 2: ["Cs_distanceFromMean", "root", "DM_"], 1: ["doNothing", "whatever", "whatever"]})
    out = generate_features(wide.select("ID", "t", "c0"), panel, {"c0": recipe})
    assert out.columns == ["t", "ID", "c0", "DM_c0", "L1_DM_c0", "L2_DM_c0", "L3_DM_c0", "L6_DM_c0"]


def test_registered_operator(wide, panel):
    register("Own_change", Operator("history", "CH_", offsets=(1,), columns=lambda p, name, out: {out: f"`{name}` - `__1_before_{name}`"}))
    try:
        out = generate_features(wide.select("ID", "t", "c0"), panel, {"c0": [Stage("Own_change")]})
        plain = add_earlier(wide.select("ID", "t", "c0"), panel, {"c0": {1}})
        want = plain.select("t", "ID", "c0", (F.col("c0") - F.col("__1_before_c0")).alias("CH_c0"))
        assert out.exceptAll(want).count() == 0
    finally:
        del OPERATORS["Own_change"]


def test_check_keys(spark, panel):
    good = spark.createDataFrame([("a", 1), ("a", 2)], "ID string, t int")
    check_keys(good, panel)
    with pytest.raises(ValueError, match="more than once"):
        check_keys(good.union(good), panel)
    with pytest.raises(ValueError, match="null"):
        check_keys(spark.createDataFrame([(None, 1)], "ID string, t int"), panel)


def test_rowwise_operators_on_a_stream(spark, wide, tmp_path):
    """Buckets, scores and flags need one row only, so they run on streams as they are."""
    wide.select(F.abs("c0").alias("e")).limit(50).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("e double").parquet(str(tmp_path / "in"))
    scored = add_normal_scores(stream, {"q": "e"}).selectExpr("*", *named(bucket_columns("e")), *named(tail_flag_columns("q")))
    query = (
        scored.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert spark.table("scored").where("q is not null and B4_e between 1 and 5").count() == 50


def test_columns_that_pass_through_and_equal_another_travel_once(spark, wide, panel):
    clones = {f"c0_{i}": "c0" for i in range(1, 40)} | {"c1_1": "c1", "c1_2": "c1_1"}
    df = wide.select("ID", "t", "c0", "c1").selectExpr("*", "c1 AS c1_1", "c1 AS c1_2", *[f"c0 AS c0_{i}" for i in range(1, 40)])
    controller = {c: KEEP for c in df.columns} | {"c1": [Stage("Ts_lags")], "c0_7": [Stage("Ts_lags"), Stage("Cs_distanceFromMax")]}
    plain = generate_features(df, panel, controller)
    short = generate_features(df, panel, controller, same=clones)
    assert short.columns == plain.columns and short.dtypes == plain.dtypes
    assert short.exceptAll(plain).count() == 0 == plain.exceptAll(short).count()
    assert "__packed" in plan_of(plain) and "__packed" not in plan_of(short)
    with pytest.raises(ValueError, match="no columns c2 that"):
        generate_features(df, panel, controller, same={"c2": "c0"})


def test_columns_that_name_each_other_as_the_same(wide, panel):
    df = wide.select("ID", "t", "c0").selectExpr("*", "c0 AS c1")
    out = generate_features(df, panel, {"c0": KEEP, "c1": KEEP}, same={"c0": "c1", "c1": "c0"})
    assert out.exceptAll(df.select("t", "ID", "c0", "c1")).count() == 0
