"""Ensemble scores, dense grids and the collocation of two grids against plain versions."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from swellgrid.plans import collocation, ensemble
from swellgrid.sources import axes
from swellgrid.sources import observations as obs

T0 = datetime(2020, 1, 1)


def ensembles(seed, n=60):
    rng = random.Random(seed)
    return [(T0 + timedelta(hours=i), 46.0, -130.0, [round(rng.gauss(2, 1), 3) for _ in range(rng.choice([0, 1, 5, 9]))], rng.choice([None, 0.0, 1.0, 2.0, 2.0, 5.0])) for i in range(n)]


def member_tables(spark, cases):
    members = [(t, la, lo, k, x) for t, la, lo, xs, _ in cases for k, x in enumerate(xs)] + [(cases[0][0], 46.0, -130.0, 99, None)]
    random.Random(1).shuffle(members)
    keys = "time timestamp_ntz, latitude double, longitude double"
    return spark.createDataFrame(members, f"{keys}, member int, x double"), spark.createDataFrame([(t, la, lo, y) for t, la, lo, _, y in cases], f"{keys}, x double")


def test_ensemble_scores_equal_pairwise_definitions(spark):
    cases = ensembles(3)
    scores = ensemble.score_ensemble(*member_tables(spark, cases), "x").withColumn("fair", ensemble.crps(F.col("members"), F.col("observed"), fair=True))
    got = {r["time"]: r for r in scores.collect()}
    wanted = {t: (xs, y) for t, _, _, xs, y in cases if xs and y is not None}
    assert set(got) == set(wanted)
    for t, (xs, y) in wanted.items():
        n, r = len(xs), got[t]
        pairs = sum(abs(a - b) for a in xs for b in xs)
        miss = sum(abs(a - y) for a in xs) / n
        mean = sum(xs) / n
        assert r["n"] == n and r["rank"] == sum(x < y for x in xs) and r["members"] == sorted(xs)
        assert r["crps"] == pytest.approx(miss - pairs / (2 * n * n)) and r["squared_error"] == pytest.approx((mean - y) ** 2)
        assert (r["fair"], r["variance"]) == ((None, None) if n == 1 else (pytest.approx(miss - pairs / (2 * n * (n - 1))), pytest.approx(sum((x - mean) ** 2 for x in xs) / (n - 1))))


def test_rank_histogram_has_every_rank_and_even_counts_for_a_fair_ensemble(spark):
    rows = spark.range(4000).select(F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, cast(id AS int))").alias("time"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.rand(5).alias("x"))
    members = rows.select("time", "latitude", "longitude", F.explode(F.array(*[F.rand(10 + k) for k in range(4)])).alias("x"))
    scores = ensemble.score_ensemble(members, rows, "x")
    found = {r["rank"]: r["count"] for r in ensemble.rank_histogram(scores).collect()}
    assert set(found) == set(range(5)) and sum(found.values()) == 4000 and all(700 < c < 900 for c in found.values())
    skill = ensemble.spread_and_skill(scores, 1.0).first()
    assert skill["cases"] == 4000 and 0.5 < skill["ratio"] * 1.2 < 1.2
    narrow = ensemble.score_ensemble(members.withColumn("x", F.lit(0.0)), rows, "x")
    assert {r["rank"]: r["count"] for r in ensemble.rank_histogram(narrow).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4000}


def test_scores_of_nothing(spark):
    members, observed = member_tables(spark, ensembles(4, 5))
    assert ensemble.score_ensemble(members.where("1 = 0"), observed, "x").count() == 0
    assert ensemble.rank_histogram(ensemble.score_ensemble(members, observed.where("1 = 0"), "x")).count() == 0


def test_dense_grids_hold_missing_cells(spark):
    rows = [(T0, 46.0, -130.0, 1.0), (T0, 46.4, -129.0, None), (T0, 46.2, -130.0, 2.0), (T0 + timedelta(1), 46.0, -129.0, 3.0), (T0 + timedelta(2), 46.4, -130.0, None)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, latitude double, longitude double, x double")
    found = axes.find_axes(df)
    grids = {r["time"]: (r["latitudes"], r["longitudes"], r["values"]) for r in axes.grid_arrays(df, "x", found).collect()}
    lats, lons = [46.0, 46.2, 46.4], [-130.0, -129.0]
    assert grids == {T0: (lats, lons, [1.0, None, 2.0, None, None, None]), T0 + timedelta(1): (lats, lons, [None, 3.0] + [None] * 4), T0 + timedelta(2): (lats, lons, [None] * 6)}
    back = obs.explode_grid(axes.grid_arrays(df, "x", found), "x")
    assert back.count() == 18 and {tuple(r) for r in back.where("x IS NOT NULL").collect()} == {r for r in rows if r[3] is not None}


def plane(lat, lon, t):
    return 2 * lat - 3 * lon + 0.5 * lat * lon + t


def test_bilinear_is_exact_for_a_bilinear_field(spark):
    grid = [(T0 + timedelta(days=t), 46 + i / 5, -130 + j / 5, plane(46 + i / 5, -130 + j / 5, t)) for t in range(2) for i in range(6) for j in range(6)]
    hole = [(t, la, lo, None if (round(la, 1), round(lo, 1)) == (46.2, -129.8) else v) for t, la, lo, v in grid]
    field = spark.createDataFrame(hole, "time timestamp_ntz, latitude double, longitude double, x double")
    points = [(46 + i / 4, -130 + j / 4) for i in range(6) for j in range(6)] + [(46.2, -129.4), (None, 1.0), (46.2, -129.4)]
    got = {(r["time"], r["latitude"], r["longitude"]): r["x"] for r in collocation.bilinear(field, "x", spark.createDataFrame(points, "latitude double, longitude double"), 0.2).collect()}
    for t in range(2):
        for la, lo in {p for p in points if p[0] is not None}:
            i, j = (la - 46) / 0.2, (lo + 130) / 0.2
            nodes = {(a, b) for a in {math.floor(i + 1e-9), math.ceil(i - 1e-9)} for b in {math.floor(j + 1e-9), math.ceil(j - 1e-9)}}
            inside = all(0 <= a < 6 and 0 <= b < 6 for a, b in nodes) and (1, 1) not in nodes
            key = (T0 + timedelta(days=t), la, lo)
            assert (key in got) == inside and (not inside or got[key] == pytest.approx(plane(la, lo, t)))


def test_nearest_step_wins_within_the_tolerance(spark):
    rng = random.Random(8)
    left = {(rng.choice("ab"), T0 + timedelta(minutes=rng.randrange(0, 9000))): rng.random() for _ in range(120)}
    right = {(rng.choice("abc"), T0 + timedelta(minutes=rng.randrange(0, 9000))): rng.random() for _ in range(60)} | {("a", T0): 0.1, ("a", T0 + timedelta(minutes=20)): 0.2}
    left["a", T0 + timedelta(minutes=10)] = 0.5  # as far from one as from the other
    schema = "k string, time timestamp_ntz"
    got = collocation.nearest_in_time(spark.createDataFrame([(*k, v) for k, v in left.items()], f"{schema}, o double"), spark.createDataFrame([(*k, v) for k, v in right.items()], f"{schema}, m double"), ["k"], 3600)
    wanted = {}
    for (k, t), o in left.items():
        near = sorted((abs((u - t).total_seconds()), u, m) for (g, u), m in right.items() if g == k and abs((u - t).total_seconds()) <= 3600)
        if near:
            wanted[k, t] = (o, near[0][1], int(near[0][0]), near[0][2])
    assert {(r["k"], r["time"]): (r["o"], r["matched_time"], r["seconds_apart"], r["m"]) for r in got.collect()} == wanted
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sources_on_two_grids(spark):
    field = spark.createDataFrame([(T0, 46 + i / 5, -130 + j / 5, 1.0 + i) for i in range(4) for j in range(4)], "time timestamp_ntz, latitude double, longitude double, x double")
    seen = [(T0 + timedelta(hours=1), 46.25, -129.75, 2.0), (T0 + timedelta(hours=1), 46.25, -129.75, 3.0), (T0 + timedelta(hours=30), 46.25, -129.75, 9.0), (T0, 46.1, -129.9, None)]
    got = collocation.compare_sources(spark.createDataFrame(seen, field.schema), field, "x", 0.2, 7200).collect()
    assert [(r["latitude"], r["longitude"], r["n"], r["mean_seconds_apart"]) for r in got] == [(46.25, -129.75, 1, 3600.0)]
    assert got[0]["bias"] == pytest.approx(2.25 - 2.5) and got[0]["rmse"] == pytest.approx(0.25)


def test_a_large_full_grid_takes_time_in_proportion(spark):
    import time

    cells = spark.range(160_000).select(F.lit(T0).alias("time"), (F.floor(F.col("id") / 400) / 5.0).alias("latitude"), (F.col("id") % 400 / 5.0).alias("longitude"), F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("x"))
    found = axes.find_axes(cells)
    began = time.perf_counter()
    wrong = axes.grid_arrays(cells, "x", found).select(F.size("values").alias("n"), F.posexplode("values")).where("NOT (col <=> if(pos % 7 > 0, cast(pos AS double), null)) OR n <> 160000")
    assert wrong.count() == 0 and time.perf_counter() - began < 40


def test_ensembles_of_a_row_are_scored_without_a_shuffle(spark):
    from swellgrid.plans.queries import _ensemble_scores

    cases = [(t, la, lo, [None, *reversed(xs)], y) for t, la, lo, xs, y in ensembles(5)]
    df = spark.createDataFrame(cases, "time timestamp_ntz, latitude double, longitude double, members array<double>, observed double")
    members, observed = member_tables(spark, ensembles(5))
    scores = ensemble.score_cases(df)
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, ensemble.score_ensemble(members, observed, "x").collect()))
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
    assert _ensemble_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
