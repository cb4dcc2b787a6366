"""Ranking, selecting and comparing sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import site_label
from ..schema import CELL, KEYS


def by_value(value: str):
    """Value falling, then latitude and longitude rising: the order of all rankings."""
    return [F.col(value).desc(), F.col("latitude").asc(), F.col("longitude").asc()]


def rank_sites_by_potential(sites: DataFrame, value: str, top_n: int = 10) -> DataFrame:
    """The ``top_n`` sites with rank and label; only those rows are ever sorted in one place."""
    top = sites.where(F.col(value).isNotNull()).orderBy(*by_value(value)).limit(top_n)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*by_value(value))))
    return ranked.select("rank", *CELL, F.col(value).alias("wave_power_flux_w_per_m"), site_label(F.col("rank")).alias("location_description"))


def top_and_bottom(sites: DataFrame, value: str, n: int = 10) -> DataFrame:
    """First and last ``n`` of the ranking, each with its rank in the whole list."""
    listed = sites.where(F.col(value).isNotNull())
    total = listed.agg(F.count("*").alias("total"))
    top = listed.orderBy(*by_value(value)).limit(n)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*by_value(value)))).withColumn("part", F.lit("top"))
    back = [F.col(value).asc(), F.col("latitude").desc(), F.col("longitude").desc()]
    bottom = listed.orderBy(*back).limit(n).withColumn("r", F.row_number().over(Window.orderBy(*back))).crossJoin(F.broadcast(total))
    bottom = bottom.withColumn("rank", (F.col("total") - F.col("r") + 1).cast("int")).withColumn("part", F.lit("bottom")).drop("r", "total")
    return top.unionByName(bottom)


def above(sites: DataFrame, value: str, least: float) -> DataFrame:
    return sites.where(F.col(value) > least)


def best_and_worst(sites: DataFrame, value: str) -> DataFrame:
    """Two rows: the first and the last site of the ranking."""
    listed = sites.where(F.col(value).isNotNull())
    best = listed.orderBy(*by_value(value)).limit(1).withColumn("site", F.lit("best"))
    worst = listed.orderBy(F.col(value).asc(), F.col("latitude").desc(), F.col("longitude").desc()).limit(1).withColumn("site", F.lit("worst"))
    return best.unionByName(worst)


def series_of(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows of ``df`` at the given sites, by equality of the coordinates."""
    return df.join(sites.select(*CELL).distinct(), CELL, "left_semi")


def time_slice(df: DataFrame, index: int) -> DataFrame:
    """All cells at the ``index``-th distinct time; negative counts from the end."""
    times = df.select("time").distinct()
    n = index + 1 if index >= 0 else -index
    nth = times.orderBy(F.col("time").asc() if index >= 0 else F.col("time").desc()).limit(n)
    pick = nth.agg(F.count("*").alias("n"), (F.max("time") if index >= 0 else F.min("time")).alias("time")).where(F.col("n") == n).select("time")
    return df.join(F.broadcast(pick), "time", "left_semi")


def nearest_cell(df: DataFrame, latitude: float | None = None, longitude: float | None = None) -> DataFrame:
    """One row: on each axis the value nearest to the point, the smaller of two; by default the middle of the axis."""

    def pick(axis: str, at: float | None) -> DataFrame:
        values = df.select(axis).where(F.col(axis).isNotNull()).distinct()
        if at is not None:
            return values.agg(F.min_by(axis, F.struct(F.abs(F.col(axis) - at), axis)).alias(axis))
        return values.agg(F.array_sort(F.collect_list(axis)).alias("v")).select(F.get("v", (F.size("v") / 2).cast("int")).alias(axis))

    return pick("latitude", latitude).crossJoin(pick("longitude", longitude))


def nearest_series(df: DataFrame, latitude: float | None = None, longitude: float | None = None) -> DataFrame:
    return df.join(F.broadcast(nearest_cell(df, latitude, longitude)), CELL, "left_semi")


def whole_matrix(sites: DataFrame, value: str) -> DataFrame:
    """The matrix over every latitude and longitude found, in long form: ``row`` and ``column`` count both axes from 0, rising.

    ``sites`` is asked the same way for both axes and for the values, null coordinates being left out by their missing
    index only, so that Spark shuffles what it is made of once and reads that three times.
    """

    def axis(name: str, index: str) -> DataFrame:
        found = sites.select(F.col(name).alias(f"{name}_")).distinct()
        place = F.row_number().over(Window.orderBy(F.col(f"{name}_").asc_nulls_last())) - 1  # as many rows as the axis has values
        return found.withColumn(index, F.when(F.col(f"{name}_").isNotNull(), place))

    rows, columns = axis("latitude", "row"), axis("longitude", "column")
    placed = sites.join(F.broadcast(rows), F.col("latitude").eqNullSafe(F.col("latitude_"))).join(F.broadcast(columns), F.col("longitude").eqNullSafe(F.col("longitude_")))
    return placed.where("row IS NOT NULL AND column IS NOT NULL").select("row", "column", *CELL, value)


def compare_best_worst(rows: DataFrame, value: str, sites: DataFrame) -> DataFrame:
    """Means of the two sites over ``rows``, their difference and ratio, one row."""
    marked = rows.join(F.broadcast(sites.select(*CELL, "site")), CELL)
    best, worst = (F.avg(F.when(F.col("site") == s, F.col(value))) for s in ("best", "worst"))
    return marked.agg(best.alias("best_mean"), worst.alias("worst_mean"), (best - worst).alias("difference"), F.try_divide(best, worst).alias("ratio"))

