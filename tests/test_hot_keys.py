"""Hot snapshots, hot values and hot entities against brute force."""

import random
from statistics import NormalDist, median

import pytest
from chronopanel import FULL, Limits, Panel, Stage, generate_features
from conftest import TINY
from pyspark.sql import functions as F

from chronopanel.operators.ecdf import ecdf_long
from chronopanel.operators.history import hot_entity_cuts
from chronopanel.operators.pieces import CrossSection
from chronopanel.operators.snapshot import snapshot_medians, snapshot_stats
from chronopanel.scale import cut_points, global_position, group_sizes, lookup_join, place_among

SMALL = Limits(rows_per_group=20)


SPREAD = Limits(rows_per_group=20, broadcast_cells=0)


@pytest.fixture(scope="module")
def skewed():
    """900 rows: a snapshot with 60 % of them, a value with 40 %, nulls, ties, -0.0, NaN."""
    rng = random.Random(7)
    rows, ids = [], list(range(560))
    for t, size in ((1, 540), (2, 200), (3, 100), (4, 59), (5, 1)):
        for i in rng.sample(ids, size):
            u = rng.random()
            x = 0.0 if u < 0.4 else None if u < 0.45 else rng.gauss(0, 50) if u < 0.8 else float(rng.randint(-5, 5))
            y = float(rng.choice([-0.0, 1, 2])) if u < 0.97 else float("nan")
            rows.append((i, t, x, y))
    return rows


def brute(rows, column):
    """{(id, t): (x, median distance, ecdf)} from the definitions."""
    value = {(r[0], r[1]): r[column] for r in rows}
    value = {k: None if v is None or v != v else v for k, v in value.items()}
    out = {}
    for (i, t), v in value.items():
        peers = [w for (_, s), w in value.items() if s == t]
        known = [w for w in peers if w is not None]
        if v is None:
            out[i, t] = (None, None, 0.0)
        else:
            out[i, t] = (v, v - median(known), sum(w <= v for w in known) / len(peers))
    return out


def test_distances_without_broadcast(spark, skewed):
    panel = Panel("id", "t")
    df = spark.createDataFrame(skewed, "id int, t int, x double, y double")
    recipe = {"x": [Stage("Cs_distanceFromMin"), Stage("Cs_distanceFromMedian")], "y": [Stage("Cs_distanceFromMax")]}
    a, b = (generate_features(df, panel, recipe, limits=limits) for limits in (SPREAD, Limits()))
    assert a.exceptAll(b).count() == 0 and a.count() == len(skewed)


@pytest.mark.parametrize("limits", [SMALL, TINY, SPREAD, Limits()], ids=["small", "tiny", "spread", "plain"])
def test_ranks_and_medians(spark, skewed, limits):
    panel = Panel("id", "t")
    df = spark.createDataFrame(skewed, "id int, t int, x double, y double").repartition(5)
    cross = CrossSection(df, panel, limits)
    got = {(r["id"], r["t"], r["__f"]): r["__e"] for r in ecdf_long(cross, ["x", "y"], ["id", "t"]).collect()}
    medians = {r["t"]: r for r in snapshot_medians(cross, ["x", "y"]).collect()}
    for f, name in enumerate(["x", "y"]):
        want = brute(skewed, 2 + f)
        assert {k[:2]: e for k, e in got.items() if k[2] == f} == {k: w[2] for k, w in want.items()}
        for (_, t), (v, distance, _) in want.items():
            if v is not None:
                assert v - medians[t][f"__median_{name}"] == distance


def test_column_missing_from_a_hot_snapshot(spark):
    rows = [(i, 0, float(i), None) for i in range(50)] + [(i, 1, None, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, t int, x double, y double")
    recipe = [Stage("Cs_ecdf"), Stage("Cs_distanceFromMedian")]
    out = generate_features(df, Panel("id", "t"), {"x": recipe, "y": recipe}, limits=SMALL)
    for r in out.collect():
        here, gone = ("x", "y") if r["t"] == 0 else ("y", "x")
        assert r[f"E_{here}"] == (r["id"] + 1) / 50 and r[f"DME_{here}"] == r["id"] - 24.5
        assert r[f"E_{gone}"] == 0.0 and r[f"DME_{gone}"] is None


def test_ranges_stay_small(spark, skewed):
    """A task orders about ``rows_per_group`` distinct values, whatever the snapshots' sizes are."""
    df = spark.createDataFrame(skewed, "id int, t int, x double, y double")
    ranks = CrossSection(df, Panel("id", "t"), SMALL).ranks(["x"])
    parts = ranks.table.sparkSession.read.parquet(next(f for f in ranks.table.inputFiles()).rsplit("/", 1)[0])
    sizes = [r["count"] for r in parts.groupBy("__part").count().collect()]
    assert sum(sizes) == ranks.sizes.groups and max(sizes) <= 3 * SMALL.rows_per_group
    assert ranks.sizes.rows == len(skewed) and ranks.sizes.largest > 200


@pytest.mark.parametrize("largest", [10**9, 10**10, 10**11, 10**12])
def test_pieces_grow_with_the_key(largest):
    assert Limits().pieces(largest) * Limits().rows_per_group == largest


def test_bad_keys_are_errors(spark):
    panel, recipe = Panel("id", "t"), {"x": [Stage("Cs_ecdf"), Stage("Cs_distanceFromMax")]}
    twice = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 9.0), ("b", 1, 5.0)], "id string, t int, x double")
    with pytest.raises(Exception, match="occurs more than once"):
        generate_features(twice, panel, recipe).collect()
    for bad in ((None, 1, 7.0), ("c", None, 7.0)):
        df = spark.createDataFrame([("a", 1, 1.0), bad], "id string, t int, x double")
        for stages in (recipe["x"], recipe["x"][:1], recipe["x"][1:]):
            with pytest.raises(ValueError, match="null id or t"):
                generate_features(df, panel, {"x": stages})


@pytest.mark.parametrize("entity,snapshot", [("f", "v"), ("e", "c"), ("e.n", "s.t")])
def test_key_names(spark, entity, snapshot):
    """Keys may be called like helper columns and hold dots."""
    rows = [("a", 1, 1.0), ("b", 1, 5.0), ("a", 2, 2.0)]
    df = spark.createDataFrame(rows, "id string, t int, x double").toDF(entity, snapshot, "x")
    recipe = [Stage("Cs_ecdf"), Stage("Cs_distanceFromMedian"), Stage("Ts_lags")]
    for limits in (Limits(), SPREAD):
        out = generate_features(df, Panel(entity, snapshot), {"x": recipe}, limits=limits).collect()
        assert sorted((r[entity], r[snapshot], r["E_x"], r["DME_x"], r["L1_x"]) for r in out if r["L1_x"]) == [("a", 2, 1.0, 0.0, 1.0)]
        assert {(r[entity], r["E_x"], r["DME_x"]) for r in out if r[snapshot] == 1} == {("a", 0.5, -2.0), ("b", 1.0, 2.0)}


def history_rows():
    rng = random.Random(3)
    rows = [("hot", t, rng.choice([None, rng.gauss(10, 3)])) for t in rng.sample(range(1000), 300)]
    rows += [(f"e{i}", t, float(rng.randint(0, 9))) for i in range(60) for t in rng.sample(range(1000), rng.randint(1, 12))]
    return rows


@pytest.mark.parametrize("limits", [SMALL, TINY, Limits()], ids=["small", "tiny", "plain"])
def test_long_histories(spark, limits):
    rows = history_rows()
    panel = Panel("id", "t")
    df = spark.createDataFrame(rows, "id string, t int, x double").repartition(4)
    if limits != Limits():
        cuts, pieces = hot_entity_cuts(df, panel, limits=limits)
        assert "hot" in {r["id"] for r in cuts.collect()}
    out = generate_features(df, panel, {"x": FULL}, limits=limits).collect()
    assert len(out) == len(rows)
    lines = {}
    for i, t, x in sorted(rows, key=lambda r: r[1]):
        lines.setdefault(i, []).append((t, x))
    means = {}
    for _, t, x in rows:
        means.setdefault(t, []).append(x)
    means = {t: [x for x in xs if x is not None] for t, xs in means.items()}
    means = {t: sum(xs) / len(xs) if xs else None for t, xs in means.items()}
    for row in out:
        line = lines[row["id"]]
        at = [t for t, _ in line].index(row["t"])
        x = line[at][1]
        for k in (1, 2, 3, 6):
            before = line[at - k] if at >= k else (None, None)
            assert row[f"L{k}_x"] == before[1]
            want = None if before[1] is None else before[1] - means[before[0]]
            assert row[f"L{k}_DM_x"] == (None if want is None else pytest.approx(want))
        for n in (2, 3, 6):
            seen = [v for _, v in line[max(0, at - n) : at + 1] if v is not None]
            if x is None:
                assert row[f"DMM_x_{n}"] is None and row[f"DMMI_x_{n}"] is None and row[f"DMMA_x_{n}"] is None
            else:
                assert row[f"DMM_x_{n}"] == pytest.approx(x - sum(seen) / len(seen))
                assert row[f"DMMI_x_{n}"] == x - min(seen)
                assert row[f"DMMA_x_{n}"] == x - max(seen)


def test_second_round_with_long_histories(spark):
    """History, ranks over a lag, and history of those ranks."""
    df = spark.createDataFrame(history_rows(), "id string, t int, x double")
    recipe = {"x": [Stage("Ts_lags"), Stage("Cs_ecdf", "L1_"), Stage("Ts_lags", "E_L1_")]}
    a, b = (generate_features(df, Panel("id", "t"), recipe, limits=limits) for limits in (TINY, Limits()))
    assert a.columns == b.columns and "L1_E_L1_x" in a.columns
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == df.count()


def test_ranks_of_many_columns(spark):
    df = spark.range(20).select("id", F.lit(1).alias("t"), *[(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(70)])
    out = generate_features(df, Panel("id", "t"), {f"c{i}": [Stage("Cs_ecdf")] for i in range(70)})
    for row in out.collect():
        assert all(row[f"E_c{i}"] == (row["id"] + 1) / 20 for i in range(70))


def test_normal_scores(spark):
    from chronopanel.operators.scores import add_normal_scores

    ps = [1e-300, 1e-20, 1e-9, 1e-4, 0.01, 0.07, 0.075, 0.2, 1 / 3, 0.5, 0.6, 0.92, 0.95, 0.999, 1 - 1e-9]
    out = add_normal_scores(spark.createDataFrame([(p,) for p in ps], "p double"), {"q": "p"}).collect()
    for row in out:
        assert row["q"] == pytest.approx(NormalDist().inv_cdf(row["p"]), rel=1e-13, abs=1e-15)
    edge = spark.createDataFrame([(0.0,), (1.0,), (-0.1,), (1.1,), (float("nan"),), (None,)], "p double")
    q = [r["q"] for r in add_normal_scores(edge, {"q": "p"}).collect()]
    assert q[:2] == [float("-inf"), float("inf")] and all(v != v for v in q[2:5]) and q[5] is None


def test_lookup_join_every_way(spark):
    rows = spark.range(1000).withColumn("k", F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 7))
    table = rows.groupBy("k").agg((F.first("k") * 10).alias("v"), F.count(F.lit(1)).alias("w")).where("k < 6")
    sizes = group_sizes(rows, F.col("k"))
    plain, shuffled = Limits(), Limits(broadcast_cells=0)
    spread = Limits(broadcast_cells=0, rows_per_group=90)
    joined = []
    for limits in (plain, shuffled, spread):
        out = lookup_join(rows, table, ["k"], sizes, "w", ["id"], limits)
        assert sorted(out.columns) == ["id", "k", "v"]
        joined.append(sorted((r["id"], r["v"]) for r in out.fillna(-1).collect()))
    assert joined[0] == joined[1] == joined[2] and len(joined[0]) == 1000


def test_global_position(spark):
    df = spark.range(0, 500, numPartitions=7).select((F.col("id") * 37 % 500).alias("a"), F.lit("x").alias("same"))
    unique = global_position(df, [F.col("a")], unique=True)
    assert sorted((r["a"], r["__pos"]) for r in unique.collect()) == [(i, i) for i in range(500)]
    tied = global_position(df, [F.col("same")], unique=False)
    assert sorted(r["__pos"] for r in tied.collect()) == list(range(500))
    assert tied.count() == 500


def test_place_among(spark):
    cuts = [1.0, 3.0, 3.5, 8.0]
    df = spark.createDataFrame([(v, cuts) for v in (0.0, 1.0, 2.0, 3.0, 3.2, 8.0, 9.0, None)], "v double, c array<double>")
    got = [r["k"] for r in place_among(df, F.col("v"), "c", 5, "k").collect()]
    assert got == [0, 0, 1, 1, 2, 3, 4, 0]


def test_lesser_hot_keys_keep_fewer_cuts(spark):
    df = spark.range(1100).select(F.when(F.col("id") < 1000, "a").otherwise("b").alias("k"), F.rand(1).alias("v"))
    hot = spark.createDataFrame([("a", 1000), ("b", 100)], "k string, __n long")
    cuts = {r["k"]: len(r["__cuts"]) for r in cut_points(df, ["k"], "v", hot, 50).collect()}
    assert cuts["a"] == 49 and cuts["b"] <= 5


def test_mean_is_order_independent_with_exact_scale(spark):
    panel = Panel("id", "t", exact_scale=2)
    rng = random.Random(1)
    rows = [(i, 0, round(rng.random() * 1e6, 2)) for i in range(999)]
    results = set()
    for seed in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "id int, t int, x double").repartition(seed + 2)
        results.add(snapshot_stats(CrossSection(df, panel), [("x", "mean")]).first()["__mean_x"])
    assert len(results) == 1


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_text_snapshots_have_no_history(spark, panel, limits):
    df = spark.createDataFrame([("a", f"2017-0{i}", float(i)) for i in range(1, 8)], "ID string, t string, x double")
    with pytest.raises(ValueError, match="t is text"):
        generate_features(df, panel, {"x": [Stage("Ts_lags")]}, limits=limits)
