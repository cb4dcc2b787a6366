"""Axis catalogue of a grid: the distinct times, latitudes and longitudes with dense indices from 0, rising.

It is written once beside a zone and answers what would else scan the rows again: the n-th time, the cell nearest to a
point, the shape, the places of a matrix.  What is picked from it is a literal of the scan that follows, so that the scan skips
directories and files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from ..schema import KEYS

#: Index column of each axis.
INDEX = {"time": "time_idx", "latitude": "lat_idx", "longitude": "lon_idx"}


@dataclass
class Axes:
    """Tables (axis, index) of the three axes."""

    time: DataFrame
    latitude: DataFrame
    longitude: DataFrame

    def of(self, axis: str) -> DataFrame:
        return getattr(self, axis)

    def shape(self) -> dict[str, int]:
        """Values on each axis."""
        return {axis: self.of(axis).count() for axis in KEYS}

    def at(self, axis: str, index: int) -> Row | None:
        """The ``index``-th value (from the end where negative) with its index, or None beyond the axis."""
        table, name = self.of(axis), INDEX[axis]
        place = F.lit(index) if index >= 0 else F.lit(table.count() + index)
        return table.where(F.col(name) == place).first()

    def nearest(self, axis: str, value: float | None = None) -> Row | None:
        """The value nearest to ``value`` with its index, the smaller of two; by default the middle of the axis."""
        table, name = self.of(axis), INDEX[axis]
        if value is None:
            return self.at(axis, table.count() // 2)
        return table.orderBy(F.abs(F.col(axis) - value), axis).limit(1).first()

    def indexed(self, df: DataFrame, *axes: str) -> DataFrame:
        """Rows with the index of their place on ``axes`` (all by default).

        The tables are left to Spark's own size check: an axis has at most as many values as its dimension.
        """
        for axis in axes or KEYS:
            df = df.join(self.of(axis), axis)
        return df


def find_axes(df: DataFrame) -> Axes:
    """Axes of rows that may repeat keys; nulls are on no axis.  Each axis reads its own column only."""

    def axis(name: str) -> DataFrame:
        found = df.select(name).where(F.col(name).isNotNull()).distinct()
        return found.withColumn(INDEX[name], F.row_number().over(Window.orderBy(name)) - 1)  # as many rows as the axis has values

    return Axes(*(axis(name) for name in KEYS))


def write_axes(df: DataFrame, path: str) -> Axes:
    """Axes of the rows of a zone, written under ``path`` (the zone's folder), where readers of the rows don't see them."""
    found = find_axes(df)
    for name in KEYS:
        found.of(name).coalesce(1).write.mode("overwrite").parquet(f"{path}/_axes/{name}")
    return read_axes(df.sparkSession, path)


def read_axes(spark: SparkSession, path: str) -> Axes:
    return Axes(*(spark.read.parquet(f"{path}/_axes/{name}") for name in KEYS))


def time_slice(df: DataFrame, axes: Axes, index: int) -> DataFrame:
    """All rows at the ``index``-th time, by a filter on a literal; none beyond the axis."""
    found = axes.at("time", index)
    return df.where(F.col("time") == F.lit(found["time"])) if found else df.where(F.lit(False))


def nearest_series(df: DataFrame, axes: Axes, latitude: float | None = None, longitude: float | None = None) -> DataFrame:
    """All rows of the cell nearest to a point on each axis, by filters on literals."""
    for axis, at in (("latitude", latitude), ("longitude", longitude)):
        found = axes.nearest(axis, at)
        df = df.where(F.col(axis) == F.lit(found[axis])) if found else df.where(F.lit(False))
    return df


def matrix(sites: DataFrame, value: str, axes: Axes) -> DataFrame:
    """(lat_idx, latitude, values): for each latitude an array over all longitudes of the catalogue, null where there is no site."""
    cells = axes.indexed(sites.select("latitude", "longitude", value), "latitude", "longitude")
    row = F.map_from_entries(F.collect_list(F.struct("lon_idx", value)))  # at most one entry for each longitude
    rows = cells.groupBy("lat_idx", "latitude").agg(row.alias("row"))
    columns = F.sequence(F.lit(0), F.lit(max(0, axes.longitude.count() - 1)))
    return rows.select("lat_idx", "latitude", F.transform(columns, lambda i: F.col("row")[i]).alias("values"))


def grid_arrays(df: DataFrame, variable: str, axes: Axes) -> DataFrame:
    """(time, latitudes, longitudes, values): a dense row-major grid for each time, null where a cell has no row or no value.

    ``df`` has each key once.  A time's cells come together in one row, as large as the grid; both axes come with each row, so that
    ``observations.explode_grid`` needs nothing else.  The grid is put together from its cells in order of their places, with the
    gaps between them, so a time costs as much as its grid is large, however many cells have values.
    """
    def listed(axis: str) -> DataFrame:
        entries = F.array_sort(F.collect_list(F.struct(INDEX[axis], axis)))
        return axes.of(axis).agg(F.transform(entries, lambda e: e[axis]).alias(f"{axis}s"))  # one row

    n_lats, n_lons = axes.latitude.count(), axes.longitude.count()
    cells = axes.indexed(df.where(F.col(variable).isNotNull()).select(*KEYS, variable), "latitude", "longitude")
    place = F.col("lat_idx") * n_lons + F.col("lon_idx")
    entries = cells.select("time", F.struct(place.alias("place"), F.col(variable).alias("value")).alias("cell"), F.lit(False).alias("listed"))
    steps = axes.time.select("time", F.lit(None).cast(entries.schema["cell"].dataType).alias("cell"), F.lit(True).alias("listed"))
    found = entries.unionByName(steps).groupBy("time").agg(F.array_sort(F.collect_list("cell")).alias("found"), F.bool_or("listed").alias("listed")).where("listed")

    def missing(n: Column) -> Column:
        return F.array_repeat(F.lit(None).cast(df.schema[variable].dataType), n)

    before = F.concat(F.array(F.lit(-1)), F.transform("found", lambda c: c["place"]))
    runs = F.zip_with("found", F.slice(before, F.lit(1), F.size("found")), lambda c, last: F.concat(missing(c["place"] - last - 1), F.array(c["value"])))
    rest = missing(n_lats * n_lons - 1 - F.element_at(before, -1))
    values = F.concat(F.flatten(runs), rest)
    return found.crossJoin(listed("latitude")).crossJoin(listed("longitude")).select("time", "latitudes", "longitudes", values.alias("values"))


def overview(df: DataFrame, axes: Axes) -> DataFrame:
    """Dimensions, size in bytes and time range, one row: the axes' from the catalogue, only the rows are counted."""
    variables = [c for c in df.columns if c not in KEYS]
    shape = axes.shape()
    ends = axes.time.agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    names: dict[str, Column] = {n: F.lit(shape[a]).cast("bigint") for n, a in (("n_times", "time"), ("n_lats", "latitude"), ("n_lons", "longitude"))}
    n = F.count("*")
    counted = df.agg(n.alias("n_rows"), (n * 8 * len(variables)).alias("n_bytes"))
    return counted.withColumns(names).crossJoin(ends).select("n_times", "n_lats", "n_lons", "n_rows", "n_bytes", "first_time", "last_time")  # one row each
