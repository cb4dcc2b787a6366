"""Climatology, monthly means, per-site summaries and consistency metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_end
from ..schema import CELL, KEYS, SUMMER, WINTER
from ..sources.axes import Axes
from ..sources.observations import reused


def calculate_monthly_aggregations(df: DataFrame, value: str) -> DataFrame:
    """Calendar-month mean, population deviation, maximum and minimum per cell over all years."""
    return df.groupBy(F.month("time").alias("month"), *CELL).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("max"), F.min(value).alias("min")
    )


def monthly_means(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Year-month mean per cell of ``values``, labelled with the month's last day; null keys drop out."""
    keyed = df.dropna(subset=KEYS)
    return keyed.groupBy(month_end(F.col("time")).alias("month_end"), *CELL).agg(*[F.avg(v).alias(v) for v in values])


def sea_months(monthly: DataFrame, needed: Sequence[str], height: str = "VHM0", least: float = 0.05) -> DataFrame:
    """Monthly rows with all of ``needed`` and a mean height above ``least``."""
    return monthly.dropna(subset=list(needed)).where(F.col(height) > least)


def site_means(monthly: DataFrame, value: str) -> DataFrame:
    """Long-term mean per cell: the mean of monthly means, not of raw rows."""
    return monthly.groupBy(*CELL).agg(F.avg(value).alias(value))


def seasonal_ratio(value: str | Column, time: str = "time", winter: Sequence[int] = WINTER, summer: Sequence[int] = SUMMER) -> Column:
    """Winter mean over summer mean as an aggregate; null unless the summer mean is positive."""
    x = F.col(value) if isinstance(value, str) else value
    month = F.month(time)
    w, s = F.avg(F.when(month.isin(*winter), x)), F.avg(F.when(month.isin(*summer), x))
    return F.when(s > 0, w / s)


def calculate_seasonal_ratio(df: DataFrame, value: str, time: str = "time") -> DataFrame:
    return df.agg(seasonal_ratio(value, time).alias("seasonal_ratio"))


def share_above(value: Column, limit: Column) -> Column:
    """Percentage of values strictly above ``limit``, missing ones left out."""
    return F.avg(F.when(value.isNull(), None).when(value > limit, 1.0).otherwise(0.0)) * 100


def calculate_consistency_metrics(df: DataFrame, value: str, threshold_percentile: float = 75.0, by: Sequence[str] = ()) -> DataFrame:
    """Deviation, variation, share above the percentile, the percentile, mean and median (all null without values).

    Two passes: the exact percentile first, then the share above it.  Per cell the two
    share a partitioning; without ``by`` the values are held for a few passes that narrow down the
    percentile, and never gathered.
    """
    x = F.col(value)
    by = list(by)
    if not by:
        with reused(df.select(x.cast("double").alias(value))) as held:
            q = threshold_percentile / 100
            found = order_percentiles(held, value, [q, 0.5])
            limits = [F.lit(found[p]).cast("double").alias(n) for p, n in ((q, "threshold"), (0.5, "median"))]
            out = _metrics(held.select(value, *limits), value, by)
            rows = out.collect()
        return df.sparkSession.createDataFrame(rows, out.schema)
    limits = grouped_percentiles(df, by, value, {"threshold": threshold_percentile / 100, "median": 0.5})
    return _metrics(df.join(limits, by, "left"), value, by)


def _metrics(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    x, mean = F.col(value), F.avg(value)
    return df.groupBy(*by).agg(
        F.stddev_pop(x).alias("std"),
        F.when(mean > 0, F.stddev_pop(x) / mean).alias("coefficient_of_variation"),
        share_above(x, F.col("threshold")).alias("pct_above"),
        F.max("threshold").alias("threshold"),
        mean.alias("mean"),
        F.max("median").alias("median"),
    )


def order_statistics(df: DataFrame, value: str, places: Sequence[int], bins: int = 4096) -> dict[int, float]:
    """Exact values at ``places`` (from 0) of the sorted non-null values of a double column, all in the same passes.

    Each pass counts ``bins`` equal slices of the intervals that hold the values and goes on in one
    slice for each place; only the counts come to the driver.
    """
    x = F.col(value)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    at = {k: (lo, hi, 0) for k in places}
    while spans := sorted({s for s in at.values() if s[0] < s[1]}):
        # The spans are slices of earlier passes, so no two overlap.
        which, slot = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (low, high, _) in enumerate(spans):
            width = (high - low) / bins
            if width <= 0 or low + width == low:
                width = high - low
            inside = x.between(F.lit(low), F.lit(high))
            which = F.when(inside, i).otherwise(which)
            slot = F.when(inside, F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")).otherwise(slot)
        counts = df.select(x.alias("x"), which.alias("span"), slot.alias("slot")).where("span IS NOT NULL").groupBy("span", "slot")
        rows = sorted(counts.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), key=lambda r: (r["span"], r["slot"]))
        for k, span in at.items():
            before = span[2]
            for r in (r for r in rows if spans[r["span"]] == span):
                if k < before + r["n"]:
                    at[k] = (r["lo"], r["hi"], before)
                    break
                before += r["n"]
    return {k: s[0] for k, s in at.items()}


def order_percentiles(df: DataFrame, value: str, points: Sequence[float]) -> dict[float, float | None]:
    """Exact percentiles with linear interpolation over a whole table; None without values."""
    n = df.agg(F.count(value)).first()[0]
    if not n:
        return dict.fromkeys(points)
    place = {q: q * (n - 1) for q in points}
    found = order_statistics(df, value, sorted({k for p in place.values() for k in (int(p), min(int(p) + 1, n - 1))}))
    return {q: (low := found[int(p)]) + (found[min(int(p) + 1, n - 1)] - low) * (p - int(p)) for q, p in place.items()}


#: Values of a group that one aggregate may hold.
GATHERED_VALUES = 200_000


def grouped_order_statistics(df: DataFrame, by: Sequence[str], value: str, places: dict[str, Column], bins: int = 1024) -> DataFrame:
    """(by, n, one column for each of ``places``): exact values at places (from 0) of the sorted non-null values of each group.

    A place is an expression of the group's count ``n``; beyond the group it gives null.  All groups narrow down
    their places in the same passes over ``df``, which should be held or cheap to read: a pass counts ``bins`` equal slices of each
    interval that still holds several values, and goes on in the slice of the place.  A pass shuffles counts only, at most
    ``bins`` rows for each task, group and interval; no group's values are gathered or sorted.  Runs a few jobs when called.
    """
    by = list(by)
    x = F.col(value)
    rows = df.where(x.isNotNull()).select(*by, x.cast("double").alias("x_"))
    spans = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("x_").alias("lo_"), F.max("x_").alias("hi_"))
    wanted = F.inline(F.array(*[F.struct(F.lit(k).alias("name_"), p.cast("bigint").alias("place_")) for k, p in places.items()]))
    state = spans.select(*by, "n", "lo_", "hi_", F.lit(0).cast("bigint").alias("before_"), wanted).where("place_ >= 0 AND place_ < n").persist()
    while state.where("lo_ < hi_").count():
        spans = state.where("lo_ < hi_").select(*by, "lo_", "hi_").distinct()
        width = (F.col("hi_") - F.col("lo_")) / bins
        slot = F.when(F.col("lo_") + width > F.col("lo_"), F.least(F.floor((F.col("x_") - F.col("lo_")) / width), F.lit(bins - 1))).otherwise(F.when(F.col("x_") < F.col("hi_"), 0).otherwise(1))
        inside = rows.join(spans, by).where(F.col("x_").between(F.col("lo_"), F.col("hi_")))
        counts = inside.groupBy(*by, "lo_", "hi_", slot.cast("int").alias("slot_")).agg(F.count("*").alias("n_"), F.min("x_").alias("low_"), F.max("x_").alias("high_"))
        order = Window.partitionBy(*by, "name_").orderBy("slot_")  # at most ``bins`` rows
        ends = F.col("before_") + F.sum("n_").over(order)
        placed = state.where("lo_ < hi_").join(counts, [*by, "lo_", "hi_"]).withColumn("end_", ends).where("place_ < end_ AND place_ >= end_ - n_")
        narrowed = placed.select(*by, "n", F.col("low_").alias("lo_"), F.col("high_").alias("hi_"), (F.col("end_") - F.col("n_")).alias("before_"), "name_", "place_")
        before, state = state, state.where("lo_ = hi_").unionByName(narrowed).persist()
        state.count()
        before.unpersist()
    return state.groupBy(*by, "n").pivot("name_", list(places)).agg(F.first("lo_"))


def grouped_percentiles(df: DataFrame, by: Sequence[str], value: str, points: dict[str, float], gathered: int = GATHERED_VALUES) -> DataFrame:
    """(by, one column for each of ``points``): exact percentiles with linear interpolation of each group that has values.

    Where no group has more than ``gathered`` values, one aggregate holds them; else ``grouped_order_statistics`` takes
    passes that hold counts only.  The largest group is counted when called.
    """
    most = df.where(F.col(value).isNotNull()).groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most <= gathered:
        return df.where(F.col(value).isNotNull()).groupBy(*by).agg(*[F.percentile(value, q).alias(name) for name, q in points.items()])
    at = {name: F.lit(q) * (F.col("n") - 1) for name, q in points.items()}
    low = {name: F.floor(p) for name, p in at.items()}
    places = {f"{name}_{side}_": p if side == "low" else F.least(p + 1, F.col("n") - 1) for name, p in low.items() for side in ("low", "high")}
    found = grouped_order_statistics(df, by, value, places)

    def between(name: str) -> Column:
        a, b = F.col(f"{name}_low_"), F.col(f"{name}_high_")
        return (a + (b - a) * (at[name] - low[name])).alias(name)

    return found.select(*by, *[between(name) for name in points])


def exact_percentiles(df: DataFrame, value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation over a whole table, one row; null without values."""
    with reused(df.select(F.col(value).cast("double").alias("x"))) as held:
        found = order_percentiles(held, "x", list(points.values()))
    return df.sparkSession.createDataFrame([tuple(found[q] for q in points.values())], ", ".join(f"{p} double" for p in points))


def site_summary(monthly: DataFrame, value: str, time: str = "month_end", above: float = 30.0, least: float = 20.0) -> DataFrame:
    """Per site over monthly means: mean, sample deviation, share of months above, seasonal ratio; sites above ``least``."""
    x = F.col(value)
    month = F.month(time)
    winter, summer = F.avg(F.when(month.isin(*WINTER), x)), F.avg(F.when(month.isin(*SUMMER), x))
    return (
        monthly.groupBy(*CELL)
        .agg(
            F.avg(x).alias("mean_pflux"),
            F.stddev_samp(x).alias("std_pflux"),
            share_above(x, F.lit(above)).alias("pct_above_30"),
            F.try_divide(winter, summer).alias("seasonal_ratio"),
        )
        .where(F.col("mean_pflux") > least)
    )


def flux_statistics(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_pop(value).alias("std"))


def generate_processing_summary(df: DataFrame, region: str = "Pacific Northwest", value: str = "wave_power_flux", stamp: bool = True, axes: Axes | None = None) -> DataFrame:
    """One row: region, run time, dates, bounds, grid points, flux statistics and consistency metrics.

    With the rows' axis catalogue the grid's shape comes from there; else three distinct counts multiply the rows.
    """
    if value not in df.columns:
        raise ValueError(f"{value} is missing: process the wave data first")
    sizes = axes.shape() if axes else {}
    n_times, n_lats, n_lons = (F.any_value(F.lit(sizes[c]).cast("bigint")) if axes else F.count_distinct(c) for c in KEYS)
    shape = df.agg(
        F.date_format(F.min("time"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("time"), "yyyy-MM-dd").alias("last_date"),
        n_times.alias("n_times"),
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"), F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
        (n_lats * n_lons).alias("grid_points"),
        F.max(value).alias("flux_max"), F.min(value).alias("flux_min"),
    )
    metrics = calculate_consistency_metrics(df, value)
    out = shape.crossJoin(metrics).withColumn("region", F.lit(region))
    return out.withColumn("processed_at", F.current_timestamp()) if stamp else out
