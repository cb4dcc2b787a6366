"""Hand-computed cases and properties of the wave operators."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from swellgrid.functions import calendar
from swellgrid.functions.flux import annual_energy_mwh, calculate_wave_power_flux, device_revenue, flux_coefficient, flux_kw, process_wave_data, revenue_per_metre
from swellgrid.operators import aggregate, ingest, quality, sites
from swellgrid.plans import forecast
from swellgrid.schema import QUALITY_LIMITS, VARIABLES, resolve_wave_columns
from swellgrid.sources import observations as obs


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_flux(spark):
    df = frame(spark, [(2.0, 10.0)], "h double, t double")
    (w, kw), = values(df, calculate_wave_power_flux(F.col("h"), F.col("t")), flux_kw(F.col("h"), F.col("t")))
    assert w == pytest.approx(490.60507169869055 * 40)
    assert kw == pytest.approx(0.49 * 40)
    assert flux_coefficient() / 1000 / 0.49 == pytest.approx(490.60507169869055 / 490)


def test_revenue_and_energy(spark):
    df = frame(spark, [(30.0,)], "kw double")
    (mwh, dollars, surface), = values(df, annual_energy_mwh(F.col("kw")), device_revenue(F.col("kw")), revenue_per_metre(F.col("kw") * 1000))
    assert mwh == pytest.approx(262.8)
    assert dollars == pytest.approx(30 * 8760 * 10 * 0.35 / 1000 * 50)
    assert surface == pytest.approx(30000 * 8760 * 1e-6 * 50)


def test_column_resolution_and_metadata(spark):
    assert resolve_wave_columns(["VHM0", "VTPK", "swh"]) == ("VHM0", "VTPK")
    assert resolve_wave_columns(["swh", "mwp"]) == ("swh", "mwp")
    with pytest.raises(ValueError):
        resolve_wave_columns(["VHM0"])
    df = frame(spark, [(1.0, 1.0)], "swh double, mwp double")
    out = process_wave_data(df)
    assert out.schema["wave_power_flux"].metadata["units"] == "W/m"
    assert df.columns == ["swh", "mwp"]


def quality_row(**changed):
    row = {"time": datetime(2020, 1, 1), "latitude": 46.0, "longitude": -130.0, **{v: 1.0 for v in VARIABLES}}
    return {**row, **changed}


@pytest.mark.parametrize(
    ("changed", "passes"),
    [
        ({"VHM0": 0.0}, True), ({"VHM0": 25.0}, True), ({"VHM0": 25.0001}, False), ({"VHM0": -0.0001}, False), ({"VHM0": None}, False),
        ({"VTPK": 0.0}, False), ({"VTPK": 30.0}, True), ({"VMDR": 360.0}, True), ({"VMDR": 360.01}, False), ({"VPED": 999.0}, True),
    ],
)
def test_quality_bounds(spark, changed, passes):
    schema = "time timestamp_ntz, latitude double, longitude double, " + ", ".join(f"{v} double" for v in VARIABLES)
    row = quality_row(**changed)
    df = spark.createDataFrame([tuple(row.values())], schema)
    masked = quality.mask_failed(df)
    assert masked.count() == 1
    assert (masked.first()["VSDX"] is not None) == passes
    assert quality.drop_failed(df).count() == int(passes)
    assert len(QUALITY_LIMITS) == 9


def test_percentiles_match_interpolation(spark):
    df = frame(spark, [(x,) for x in (1.0, 2.0, 3.0, 10.0, None)], "x double")
    row = aggregate.exact_percentiles(df, "x", {"p": 0.75, "m": 0.5}).first()
    assert (row["p"], row["m"]) == (4.75, 2.5)
    m = aggregate.calculate_consistency_metrics(df, "x").first()
    assert m["pct_above"] == 25.0 and m["threshold"] == 4.75 and m["mean"] == 4.0
    empty = aggregate.calculate_consistency_metrics(df.where("x > 99"), "x").collect()
    assert len(empty) == 1 and all(v is None for v in empty[0])


def test_percentiles_of_ties(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("double").alias("x"))
    got = aggregate.exact_percentiles(df, "x", {"a": 0.0, "b": 0.5, "c": 1.0}).first()
    assert tuple(got) == (0.0, 1.0, 2.0)


def test_single_month(spark):
    df = frame(spark, [(date(2020, 1, 31), 46.0, -130.0, 40.0)], "month_end date, latitude double, longitude double, pflux double")
    row = aggregate.site_summary(df, "pflux").first()
    assert row["std_pflux"] is None and row["mean_pflux"] == 40.0 and row["seasonal_ratio"] is None
    assert df.agg(F.stddev_pop("pflux")).first()[0] == 0.0


def test_seasonal_ratio_without_summer(spark):
    df = frame(spark, [(datetime(2020, 1, 1), 4.0), (datetime(2020, 7, 1), 0.0)], "time timestamp_ntz, x double")
    assert aggregate.calculate_seasonal_ratio(df, "x").first()[0] is None
    df = frame(spark, [(datetime(2020, 1, 1), 4.0), (datetime(2020, 7, 1), 2.0)], "time timestamp_ntz, x double")
    assert aggregate.calculate_seasonal_ratio(df, "x").first()[0] == 2.0


def test_mean_of_monthly_means(spark):
    rows = [(datetime(2020, 1, d), 46.0, -130.0, 1.0) for d in range(1, 10)] + [(datetime(2020, 2, 1), 46.0, -130.0, 3.0)]
    df = frame(spark, rows, "time timestamp_ntz, latitude double, longitude double, x double")
    monthly = aggregate.monthly_means(df, ["x"])
    assert {r["month_end"] for r in monthly.collect()} == {date(2020, 1, 31), date(2020, 2, 29)}
    assert aggregate.site_means(monthly, "x").first()["x"] == 2.0


def test_ranking_breaks_ties_by_place(spark):
    df = frame(spark, [(47.0, -129.0, 5.0), (46.0, -128.0, 5.0), (46.0, -129.0, 5.0), (50.0, -129.0, None), (48.0, -125.0, 1.0)], "latitude double, longitude double, p double")
    top = sites.rank_sites_by_potential(df, "p", 2).orderBy("rank").collect()
    assert [(r["latitude"], r["longitude"], r["location_description"]) for r in top] == [(46.0, -129.0, "Site 1"), (46.0, -128.0, "Site 2")]
    both = sites.top_and_bottom(df, "p", 1).collect()
    assert {(r["part"], r["rank"]) for r in both} == {("top", 1), ("bottom", 4)}


def test_lag_counts_rows_not_months(spark):
    rows = [(46.0, -130.0, date(2020, m, 28), float(m)) for m in (1, 2, 4)]
    df = frame(spark, rows, "latitude double, longitude double, month_end date, p double")
    got = {r["month_end"].month: r["lag1"] for r in forecast.lag_features(df, "p").collect()}
    assert got == {2: 1.0, 4: 2.0}


def test_split_is_the_floating_point_floor(spark):
    df = spark.range(90).select(F.lit(46.0).alias("latitude"), F.lit(-130.0).alias("longitude"), F.expr("date_add(date'2000-01-01', cast(id as int))").alias("month_end"), F.lit(1.0).alias("p"), F.lit(1.0).alias("lag1"))
    assert forecast.split_by_time(df).where("train").count() == 62


def test_constant_lag_fits_flat(spark):
    df = frame(spark, [(46.0, -130.0, 1.0, y, True) for y in (1.0, 2.0, 3.0)], "latitude double, longitude double, lag1 double, p double, train boolean")
    row = forecast.fit_lag(df, "p").first()
    assert (row["slope"], row["intercept"]) == (0.0, 2.0)


def test_dedup_is_deterministic_and_idempotent(spark):
    rows = [(datetime(2020, 1, 1), 46.0, -130.0, 1.0, 2), (datetime(2020, 1, 1), 46.0, -130.0, 9.0, 1), (datetime(2020, 1, 1), 46.0, -129.8, 3.0, 1)]
    df = frame(spark, rows, "time timestamp_ntz, latitude double, longitude double, x double, o int")
    once = ingest.dedup_observations(df, ["o"])
    assert sorted(r["x"] for r in once.collect()) == [3.0, 9.0]
    assert ingest.dedup_observations(once).count() == 2


def test_chunk_plan(spark):
    plan = ingest.chunk_plan(spark, "2020-01-31 00:00:00", "2020-04-10 00:00:00").orderBy("chunk_start").collect()
    assert [r["chunk_start"].date() for r in plan] == [date(2020, 1, 31), date(2020, 2, 28), date(2020, 3, 28)]
    assert plan[-1]["chunk_end"] == datetime(2020, 4, 10)
    assert plan[0]["chunk_name"] == "20200131_20200228"
    ledger = frame(spark, [(plan[0]["chunk_name"],)], "chunk_name string")
    assert ingest.pending_chunks(ingest.chunk_plan(spark, "2020-01-31 00:00:00", "2020-04-10 00:00:00"), ledger).count() == 2


def test_chunk_plan_matches_the_long_run(spark):
    assert ingest.chunk_plan(spark, "1980-01-01 21:00:00", "2023-04-30 21:00:00").count() == 520


def test_nan_becomes_null(spark):
    df = frame(spark, [(float("nan"),), (None,), (1.0,)], "x double")
    assert obs.nan_to_null(df).where("x IS NOT NULL").count() == 1


def test_grid_explodes_row_major(spark):
    df = frame(spark, [(datetime(2020, 1, 1), [46.0, 46.2], [-130.0, -129.8, -129.6], [float(i) for i in range(6)])], "time timestamp_ntz, latitudes array<double>, longitudes array<double>, values array<double>")
    got = {(r["latitude"], r["longitude"]): r["x"] for r in obs.explode_grid(df, "x").collect()}
    assert got[46.2, -129.6] == 5.0 and got[46.0, -129.8] == 1.0


def test_histogram_closes_the_last_bin(spark):
    df = frame(spark, [(float(x),) for x in range(11)], "x double")
    got = {r["bin"]: r["n"] for r in quality.histogram(df, "x", 5).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}


def test_nearest_cell_and_time_slice(spark):
    rows = [(datetime(2020, 1, d), lat, -130.0, 1.0) for d in (1, 2, 3) for lat in (46.0, 46.2, 46.4)]
    df = frame(spark, rows, "time timestamp_ntz, latitude double, longitude double, x double")
    assert sites.nearest_cell(df, 46.29, 0.0).first()["latitude"] == 46.2
    assert sites.nearest_cell(df).first()["latitude"] == 46.2
    assert {r["time"].day for r in sites.time_slice(df, -1).collect()} == {3}
    assert {r["time"].day for r in sites.time_slice(df, 0).collect()} == {1}
    assert sites.time_slice(df, 99).count() == 0


def test_labels(spark):
    df = frame(spark, [("a/b/20200101_20200201.nc", 46.123, -130.0, 2.125, 1)], "path string, lat double, lon double, x double, r int")
    (name, place, shown, site), = values(df, calendar.file_name(F.col("path")), calendar.coordinate_label(F.col("lat"), F.col("lon")), calendar.display(F.col("x")), calendar.site_label(F.col("r")))
    assert (name, place, float(shown), site) == ("20200101_20200201", "46.12, -130.0", 2.12, "Site 1")


def test_zone_layout_round_trip_prunes_by_year(spark, tmp_path):
    rows = [(datetime(y, 1, 1), 46.0, -130.0, 1.0) for y in (2019, 2020, 2021)]
    df = frame(spark, rows, "time timestamp_ntz, latitude double, longitude double, VHM0 double")
    path = obs.write_zone(df, str(tmp_path), "processed", "spatial_subsets")
    back = obs.read_observations(spark, path, {"min_lat": 46.0, "max_lat": 50.5, "min_lon": -130.0, "max_lon": -124.0}, "2020-01-01", "2020-12-31", suffix="*")
    assert back.count() == 1
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [" in plan


def test_stream_ingest_takes_each_file_once(spark, tmp_path):
    from swellgrid.streaming.ingest import ingest as run

    schema = "time timestamp_ntz, latitude double, longitude double, VHM0 double"
    first = frame(spark, [(datetime(2020, 1, 1), 46.0, -130.0, 1.0), (datetime(2020, 1, 2), 46.0, -130.0, float("nan"))], schema)
    second = frame(spark, [(datetime(2020, 1, 2), 46.0, -130.0, 2.0), (datetime(2020, 1, 3), 46.0, -130.0, 3.0)], schema)
    source, target, ledger = (str(tmp_path / n) for n in ("raw", "clean", "ledger"))
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(source)
        run(spark, source, target, ledger, first.schema)
    run(spark, source, target, ledger, first.schema)
    got = spark.read.parquet(target)
    assert got.count() == 3  # the overlap at 2 January is taken once
    assert got.where("VHM0 IS NULL").count() == 1


STREAM = "time timestamp_ntz, latitude double, longitude double, VHM0 double, o int"


def month_rows(month, days=range(1, 11), o=1, height=1.0, lat=46.0):
    return [(datetime(2020, month, d), lat, -130.0, height, o) for d in days]


def run_drops(spark, tmp_path, drops, order=("o",), **options):
    from swellgrid.streaming.ingest import ingest as run

    source, target, ledger = (str(tmp_path / n) for n in ("raw", "clean", "ledger"))
    for rows in drops:
        part = frame(spark, rows, STREAM)
        part.coalesce(1).write.mode("append").parquet(source)
        run(spark, source, target, ledger, part.schema, order=order, **options)
    return sorted(tuple(r) for r in spark.read.parquet(target).select("time", "latitude", "longitude", "VHM0", "o").collect())


def test_late_and_retried_files_lose_no_row(spark, tmp_path):
    june, january, march = month_rows(6), month_rows(1), month_rows(3)
    got = run_drops(spark, tmp_path, [june, january, march[:4], march])
    assert got == sorted(june + january + march)


def test_the_least_row_stays_whenever_it_comes(spark, tmp_path):
    first, better, worse = month_rows(6, o=5), month_rows(6, range(3, 7), o=2, height=2.0), month_rows(6, range(5, 9), o=9, height=9.0)
    got = run_drops(spark, tmp_path, [first, worse, better, worse + better + first])
    assert got == sorted(first[:2] + better + first[6:])


def test_without_an_order_the_first_to_arrive_stays(spark, tmp_path):
    assert run_drops(spark, tmp_path, [month_rows(6, o=5), month_rows(6, o=2), month_rows(7, o=1)], order=()) == sorted(month_rows(6, o=5) + month_rows(7, o=1))


def test_rows_without_a_key_or_outside_the_box_go(spark, tmp_path):
    rows = [*month_rows(6), (None, 46.0, -130.0, 1.0, 1), (datetime(2020, 6, 1), None, -130.0, 1.0, 1), *month_rows(6, lat=10.0)]
    box = {"min_lat": 45.0, "max_lat": 50.0, "min_lon": -131.0, "max_lon": -129.0}
    assert run_drops(spark, tmp_path, [rows, month_rows(6, range(20, 21), lat=9.0)], box=box) == sorted(month_rows(6))


def test_a_batch_that_died_while_months_were_moved_is_finished(spark, tmp_path):
    from swellgrid.streaming.ingest import MonthTable, upsert

    table = MonthTable(spark, str(tmp_path / "clean"))
    old, new = frame(spark, month_rows(1) + month_rows(2), STREAM), frame(spark, month_rows(1, range(8, 13), o=0) + month_rows(2, range(20, 22)), STREAM)
    upsert(old, 0, table, ["o"])
    real = table.replace
    table.replace = lambda batch: None  # dies before it moves anything
    upsert(new, 1, table, ["o"])
    assert table.is_staged(1)
    table._fs.delete(table._hadoop_path(f"{table.path}/year=2020/month=1"), True)
    table._fs.rename(table._hadoop_path(f"{table.staged(1)}/year=2020/month=1"), table._hadoop_path(f"{table.path}/year=2020/month=1"))
    table._fs.delete(table._hadoop_path(f"{table.path}/year=2020/month=2"), True)  # dies between deletion and move
    table.replace = real
    for _ in range(2):
        upsert(new, 1, table, ["o"])
        got = sorted(tuple(r) for r in table.read(new.schema).collect())
        assert got == sorted(month_rows(1, range(1, 8)) + month_rows(1, range(8, 13), o=0) + month_rows(2) + month_rows(2, range(20, 22)))
    assert table.months() == [(2020, 1), (2020, 2)]


def test_only_touched_months_are_rewritten(spark, tmp_path):
    run_drops(spark, tmp_path, [month_rows(1) + month_rows(2)])
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "clean").rglob("part-*.parquet")}
    run_drops(spark, tmp_path, [month_rows(2, range(25, 27))])
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "clean").rglob("part-*.parquet")}
    assert {p for p in before if after.get(p) == before[p]} == {p for p in before if "month=1" in str(p)}


def test_a_full_month_has_many_files_of_like_size(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.expr("timestamp_ntz'2020-03-01 00:00:00' + make_dt_interval(0, 3 * cast(id % 240 AS int)) + if(id % 10 = 0, make_dt_interval(cast(40 + id % 200 AS int)), make_dt_interval(0))").alias("time"),
        (46 + F.floor(F.col("id") / 240) / 5.0).alias("latitude"), (F.lit(-130.0)).alias("longitude"), F.rand(1).alias("VHM0"),
    )
    path = obs.write_zone(rows.repartition(7), str(tmp_path), "processed", "waves", ("year", "month"), rows_per_file=2000)
    files = spark.read.parquet(path).groupBy("year", "month", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("bytes"))
    files = files.agg(F.count("*").alias("n"), F.min(F.struct("time", "latitude")).alias("low"), F.max(F.struct("time", "latitude")).alias("high")).collect()
    march = sorted((r for r in files if r["month"] == 3), key=lambda r: r["low"])
    assert sum(r["n"] for r in files) == 20_000 and 7 <= len(march) <= 12
    inner = march[1:-1]
    assert max(r["n"] for r in inner) < 2 * min(r["n"] for r in inner) and max(r["bytes"] for r in inner) < 2 * min(r["bytes"] for r in inner)
    assert all(a["high"] < b["low"] for a, b in zip(march, march[1:]))


def test_inventory_skips_what_is_not_a_file_of_rows(spark, tmp_path):
    from swellgrid.sources.inventory import landed_files, landed_units

    schema = "time timestamp_ntz, latitude double, longitude double"
    rows = [(datetime(2020, 1, d), 46.0, -130.0) for d in range(1, 5)]
    for name, part in (("20200101_20200201", rows[:3]), ("20200201_20200301", []), ("20200301_20200401", rows[3:])):
        frame(spark, part, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    flat = tmp_path / "all"
    flat.mkdir()
    for folder in tmp_path.glob("2020*"):
        for i, f in enumerate(folder.glob("part-*.parquet")):
            f.rename(flat / (f"{folder.stem}.parquet" if not i else f"{folder.stem}_{i}.parquet"))
    (flat / "20200501_20200601.nc").write_text("another format")
    (flat / "20200601_20200701.parquet").write_text("cut off")
    files = landed_files(spark, str(flat), schema=schema)
    assert {(r["chunk_name"], r["n_files"], r["n_rows"], r["first_time"].day, r["last_time"].day) for r in landed_units(files).collect()} == {("20200101_20200201", 1, 3, 1, 3), ("20200301_20200401", 1, 1, 4, 4)}
    assert files.where("n_bytes > 0").count() == 2
    plan = ingest.chunk_plan(spark, "2020-01-01", "2020-07-01")
    assert sorted(r["chunk_name"][4:6] for r in ingest.pending_chunks(plan, landed_units(files)).collect()) == ["02", "04", "05", "06"]


@pytest.mark.parametrize(("start", "end"), [("2020-01-31 00:00:00", "2020-04-10 00:00:00"), ("2019-11-15 06:00:00", "2021-03-02 09:00:00"), ("2020-02-01 00:00:00", "2020-02-02 00:00:00")])
def test_units_by_arithmetic_are_those_of_the_plan(spark, start, end):
    times = spark.range(0, 700 * 8).select(F.expr("timestamp_ntz'2019-10-01 00:00:00' + make_dt_interval(0, 3 * cast(id AS int))").alias("time"))
    named = times.withColumn("unit", ingest.unit_of(F.col("time"), start, end))
    plan = ingest.chunk_plan(spark, start, end)
    wanted = times.join(plan, (F.col("time") >= F.col("chunk_start")) & (F.col("time") < F.col("chunk_end")))
    assert {tuple(r) for r in named.where("unit IS NOT NULL").collect()} == {(r["time"], r["chunk_name"]) for r in wanted.collect()}


def grid_rows(spark):
    rows = [(datetime(2020, 1, 1 + t), 46.0 + i / 5, -130.0 + j / 5, float(t + i * j)) for t in range(6) for i in range(4) for j in range(5) if (t + i + j) % 4]
    return rows, frame(spark, rows + rows[:7] + [(None, None, -129.8, 0.0)], "time timestamp_ntz, latitude double, longitude double, x double")


def test_axes_are_dense_and_written_beside_the_rows(spark, tmp_path):
    from swellgrid.sources import axes

    rows, df = grid_rows(spark)
    path = obs.write_zone(df.dropna(), str(tmp_path), "processed", "grid", ("year", "month"), files=3)
    axes.write_axes(df, path)
    found = axes.read_axes(spark, path)
    assert spark.read.parquet(path).count() == len(rows) + 7
    for k, name in enumerate(("time", "latitude", "longitude")):
        wanted = sorted({r[k] for r in rows} | ({-129.8} if name == "longitude" else set()))
        assert sorted(tuple(r) for r in found.of(name).collect()) == [(v, i) for i, v in enumerate(wanted)]
    assert found.shape() == {"time": 6, "latitude": 4, "longitude": 5}
    assert found.at("time", -1)["time"].day == 6 and found.at("time", 6) is None and found.at("time", -7) is None
    assert (found.nearest("latitude", 46.3)["latitude"], found.nearest("latitude", 99.0)["lat_idx"], found.nearest("longitude")["lon_idx"]) == (46.2, 3, 2)
    assert found.indexed(df.dropna()).where("lat_idx = 3 AND lon_idx = 4 AND time_idx = 2").count() == df.where("latitude > 46.5 AND longitude > -129.3 AND day(time) = 3").count()


def test_slices_come_from_the_catalogue_by_literals(spark, tmp_path):
    from swellgrid.sources import axes

    rows, df = grid_rows(spark)
    path = obs.write_zone(df.dropna(), str(tmp_path), "processed", "grid", ("year", "month"), files=3)
    found, zone = axes.write_axes(df, path), obs.read_observations(spark, path)
    got = axes.time_slice(zone, found, -2)
    assert {r["time"].day for r in got.collect()} == {5} and got.count() == zone.where("day(time) = 5").count()
    near = axes.nearest_series(zone, found, 46.33, -129.41)
    assert {(r["latitude"], r["longitude"]) for r in near.collect()} == {(46.4, -129.4)}
    for plan in (got._jdf.queryExecution().executedPlan().toString(), near._jdf.queryExecution().executedPlan().toString()):
        assert "Aggregate" not in plan and "Join" not in plan and "PushedFilters: [" in plan
    assert axes.time_slice(zone, found, 50).count() == 0
    nothing = axes.find_axes(df.where("1 = 0"))
    assert axes.nearest_series(df, nothing, 1.0, 1.0).count() == 0 and nothing.shape()["time"] == 0


def test_matrix_has_a_value_for_each_longitude(spark):
    from swellgrid.sources import axes

    rows, df = grid_rows(spark)
    sites_ = df.dropna().where("day(time) = 2").dropDuplicates()
    got = {r["lat_idx"]: r["values"] for r in axes.matrix(sites_, "x", axes.find_axes(df)).collect()}
    assert got == {i: [float(1 + i * j) if (1 + i + j) % 4 else None for j in range(5)] for i in range(4)}


def test_overlaps_go_without_a_sort_of_all_rows(spark):
    rows = [(1, 46.0, None, 2, "late"), (1, 46.0, None, 1, "first"), (2, 46.0, -130.0, 5, "alone"), (None, 1.0, 1.0, 3, "b"), (None, 1.0, 1.0, 2, None), (3, float("nan"), 0.0, 1, "n"), (3, float("nan"), -0.0, 0, "m")]
    df = frame(spark, rows, "time int, latitude double, longitude double, o int, x string")
    once = ingest.dedup_observations(df, ["o"])
    assert once.columns == ["time", "latitude", "longitude", "x"]
    assert {r["x"] for r in once.collect()} == {"first", "alone", None, "m"} and once.count() == 4
    assert "SortAggregate" not in once._jdf.queryExecution().executedPlan().toString()
    assert ingest.dedup_observations(df.where("1 = 0"), ["o"]).count() == 0


def test_extreme_events_and_folds(spark):
    rows = [(datetime(2020, 1, d), 46.0, -130.0, 10.0 if d in (5, 6, 20) else 1.0) for d in range(1, 29)]
    df = frame(spark, rows, "time timestamp_ntz, latitude double, longitude double, x double")
    events = forecast.extreme_events(df, "x", 0.85, 72).orderBy("event").collect()
    assert [(e["n"], e["start_time"].day) for e in events] == [(2, 5), (1, 20)]
    features = df.select("latitude", "longitude", F.col("time").alias("month_end"), "x", F.col("x").alias("lag1"))
    folded = forecast.expanding_folds(features, 4)
    assert folded.where("NOT train").groupBy("fold").count().count() == 4


def test_whole_matrix_has_every_longitude(spark):
    rows = [(46.0 + i % 3, -130.0 + i / 5.0, float(i)) for i in range(40)]
    df = frame(spark, rows, "latitude double, longitude double, p double")
    got = {tuple(r) for r in sites.whole_matrix(df, "p").collect()}
    assert got == {(i % 3, i, 46.0 + i % 3, -130.0 + i / 5.0, float(i)) for i in range(40)}


def test_site_matrix_all_keeps_all_sites(spark):
    from swellgrid.plans.queries import site_flux, site_matrix_all

    data = "/root/testdata/sf0.1"
    out = site_matrix_all(spark, data)
    assert out.count() == site_flux(spark, data).count()
    assert out.select("column_index").distinct().count() == 40


def test_order_statistics_in_shared_passes(spark):
    import random

    rng = random.Random(7)
    xs = [rng.choice([0.0, 1.5, rng.gauss(0, 1e-6), rng.gauss(0, 1e6)]) for _ in range(400)]
    df = frame(spark, [(x,) for x in xs] + [(None,)], "x double")
    places = [0, 1, 99, 100, 199, 300, 398, 399]
    assert aggregate.order_statistics(df, "x", places, bins=8) == {k: sorted(xs)[k] for k in places}


def test_percentiles_of_groups_in_shared_passes(spark):
    import random

    rng = random.Random(11)
    rows = [(g, h, rng.choice([None, 0.0, -1.5, rng.gauss(0, 1e-7), rng.gauss(0, 1e7), 3.0])) for g in range(6) for h in "ab" for _ in range(rng.choice([1, 2, 3, 90]))]
    rows += [(9, "a", 5.0)] * 40 + [(8, "a", None), (7, "a", 1.0), (7, "a", 1.0 + 2**-52)]
    df = frame(spark, rows, "g int, h string, x double").repartition(3)
    points = {"p0": 0.0, "low": 0.1, "mid": 0.5, "high": 0.75, "p1": 1.0}
    one = {r[:2]: r[2:] for r in map(tuple, aggregate.grouped_percentiles(df, ["g", "h"], "x", points).collect())}
    many = {r[:2]: r[2:] for r in map(tuple, aggregate.grouped_percentiles(df, ["g", "h"], "x", points, gathered=0).collect())}
    assert one == {k: pytest.approx(v, rel=1e-15) for k, v in many.items()} and (8, "a") not in many
    assert aggregate.grouped_percentiles(df.where("1 = 0"), ["g"], "x", points, gathered=-1).count() == 0
    places = aggregate.grouped_order_statistics(df, ["g", "h"], "x", {"first": F.lit(0), "third": F.lit(2)}, bins=4)
    for r in places.collect():
        xs = sorted(x for g, h, x in rows if (g, h) == (r["g"], r["h"]) and x is not None)
        assert (r["n"], r["first"], r["third"]) == (len(xs), xs[0], xs[2] if len(xs) > 2 else None)


def test_consistency_metrics_take_few_jobs(spark):
    df = spark.range(5000).select((F.rand(3) * 100).alias("x"))
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    aggregate.calculate_consistency_metrics(df, "x").collect()
    assert len(set(tracker.getJobIdsForGroup()) - before) <= 24  # an adaptive query is up to three jobs


def test_reused_is_held_and_let_go(spark):
    df = spark.range(10)
    with obs.reused(df) as held:
        assert held.is_cached and held.count() == 10
    assert not df.is_cached


def test_small_files_of_a_zone_share_tasks(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.expr("timestamp_ntz'2020-03-30 00:00:00' + make_dt_interval(0, cast(id % 100 AS int))").alias("time"),
        (46 + F.floor(F.col("id") / 100) / 5.0).alias("latitude"), F.lit(-130.0).alias("longitude"), F.rand(1).alias("VHM0"),
    )
    path = obs.write_zone(rows.repartition(7), str(tmp_path), "processed", "waves", ("year", "month"), rows_per_file=100)
    files = spark.read.parquet(path).groupBy("month", F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n"), F.min(F.struct("time", "latitude")).alias("low"), F.max(F.struct("time", "latitude")).alias("high")).collect()
    assert sum(r["n"] for r in files) == 20_000 and max(r["n"] for r in files) <= 100 and 200 <= len(files) <= 202
    assert len({r["f"].split("-")[1] for r in files}) == 1  # the task that wrote it
    for month in (3, 4):
        listed = sorted((r for r in files if r["month"] == month), key=lambda r: r["low"])
        assert all(a["high"] < b["low"] for a, b in zip(listed, listed[1:]))


def test_overlaps_are_settled_by_one_shuffle(spark):
    from swellgrid.plans.queries import monthly

    df = spark.range(10).selectExpr("timestamp_ntz'2020-01-01 00:00:00' AS time", "46.0 AS latitude", "-130.0 AS longitude", "id AS o", "id * 2.0 AS x")
    assert ingest.dedup_observations(df, ["o"])._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert monthly(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2


def test_the_matrix_reads_one_shuffle_of_the_rows(spark):
    from swellgrid.plans.queries import site_matrix_all

    out = site_matrix_all(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_COL") == 1 and plan.count("ReusedExchange") >= 1
    odd = frame(spark, [(46.0, None, 1.0), (None, 1.0, 2.0), (47.0, 2.0, None)], "latitude double, longitude double, p double")
    assert [tuple(r) for r in sites.whole_matrix(odd, "p").collect()] == [(1, 1, 47.0, 2.0, None)]


def test_a_merge_shuffles_once_and_takes_months_in_pieces(spark, tmp_path, monkeypatch):
    from swellgrid.streaming import ingest as stream

    schema = "time timestamp_ntz, latitude double, longitude double, x double, o int"
    rows = [(datetime(2020, 1 + k % 2, 1 + k % 5), 46.0 + k / 5, -130.0, float(k), 1) for k in range(60)]
    new = frame(spark, rows + [(*r[:3], -1.0, 0) for r in rows[:20]] + [(*r[:3], -2.0, 2) for r in rows[20:]], schema)
    held = frame(spark, [(*r[:3], 9.0, 1 if k > 50 else -1) for k, r in enumerate(rows) if k > 40], schema)
    for order, wanted in ((["o"], lambda k, x: 9.0 if k > 40 else -1.0 if k < 20 else x), ([], lambda k, x: 9.0 if k > 40 else None)):
        merged = stream.merge_rows(held, new, order, 3)
        assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        got = {r["latitude"]: r for r in merged.collect()}
        assert len(got) == merged.count() == 60 and all(wanted(k, r[3]) in (None, got[r[1]]["x"]) for k, r in enumerate(rows))
    monkeypatch.setattr(stream, "ROWS_PER_PIECE", 20)
    table = stream.MonthTable(spark, str(tmp_path / "t"))
    for batch in (0, 1):  # the same rows again change nothing
        stream.upsert(new, batch, table, ["o"])
        assert sorted(r["x"] for r in table.read(new.schema).collect()) == sorted([-1.0] * 20 + [float(k) for k in range(20, 60)])
