"""Reading, reshaping and writing long observation tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..schema import CELL, KEYS, OBSERVATIONS, VARIABLES


#: Rows of a file of a zone.
ROWS_PER_FILE = 5_000_000
#: Rows that one task sorts and writes where files are smaller than that.
ROWS_PER_RANGE = 250_000


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values are NULL from here on: NaN would pass every ``>`` test."""
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, (FloatType, DoubleType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c).cast("double")).alias(c) if c in real else F.col(c) for c in df.columns])


@contextmanager
def reused(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """``df`` kept for several passes: computed by the first and held, on disk where memory is short, until the end of the block."""
    kept = df.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist()


def in_box(min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> Column:
    """Inclusive bounding box."""
    return F.col("latitude").between(min_lat, max_lat) & F.col("longitude").between(min_lon, max_lon)


def in_period(start: datetime | str, end: datetime | str, time_col: str = "time") -> Column:
    """Inclusive time window."""
    at = F.col(time_col)
    return (at >= F.lit(str(start)).cast("timestamp_ntz")) & (at <= F.lit(str(end)).cast("timestamp_ntz"))


def read_observations(
    spark: SparkSession,
    path: str,
    box: dict[str, float] | None = None,
    start: str | None = None,
    end: str | None = None,
    variables: Sequence[str] | None = None,
    schema: StructType | None = None,
    suffix: str = "*.parquet",
) -> DataFrame:
    """Table under ``path`` restricted to a box, a period and some variables.

    Filters are on plain columns, so they reach the Parquet scan; where the layout is
    partitioned by year, the period's years are added so that it prunes directories too.
    """
    reader = spark.read.option("pathGlobFilter", suffix)
    df = (reader.schema(schema) if schema else reader).parquet(path)
    if box:
        df = df.where(in_box(**box))
    if start and end:
        df = df.where(in_period(start, end))
        if "year" in df.columns:
            df = df.where(F.col("year").between(int(start[:4]), int(end[:4])))
    if variables:
        df = df.select(*KEYS, *variables)
    return nan_to_null(df)


def explode_grid(df: DataFrame, variable: str, lat: str = "latitudes", lon: str = "longitudes", values: str = "values") -> DataFrame:
    """Rows of (time, latitudes, longitudes, row-major values) -> long rows with ``variable``."""
    rows = df.select("time", F.col(lat).alias("lats"), F.col(lon).alias("lons"), F.posexplode(values).alias("i", variable))
    n = F.size("lons")
    return rows.select("time", F.get("lats", (F.col("i") / n).cast("int")).alias("latitude"), F.get("lons", F.col("i") % n).alias("longitude"), variable)


def tidy(df: DataFrame, variables: Sequence[str] = VARIABLES) -> DataFrame:
    """One row per observation and variable."""
    return df.unpivot(KEYS, list(variables), "variable", "value")


def dataset_overview(df: DataFrame) -> DataFrame:
    """Dimensions, size in bytes and time range, one row."""
    variables = [c for c in df.columns if c not in KEYS]
    return df.agg(
        F.count_distinct("time").alias("n_times"),
        F.count_distinct("latitude").alias("n_lats"),
        F.count_distinct("longitude").alias("n_lons"),
        F.count("*").alias("n_rows"),
        (F.count("*") * 8 * len(variables)).alias("n_bytes"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
    )


def write_zone(
    df: DataFrame, root: str, zone: str, folder: str, partition: Sequence[str] = ("year",), mode: str = "overwrite", rows_per_file: int = ROWS_PER_FILE, files: int | None = None
) -> str:
    """Write to ``root/zone/folder`` by year (and month), in files of about ``rows_per_file`` rows that are sorted by time and cell.

    Rows are dealt out by ranges of (directory, time, cell) whose bounds Spark samples: a directory with
    most of the rows gets most of the files, small ones share a task, and within a directory the ranges of the
    files don't overlap, so that a period or a box skips files by their statistics.  The rows are counted first,
    unless ``files``, the number of ranges, is given.  A range has a file or more: where files are small, a task writes many of
    them one after the other, so that tasks, samples and shuffle blocks follow the rows and not the files.
    """
    path = f"{root}/{zone}/{folder}"
    parts = {"year": F.year("time"), "month": F.month("time")}
    out = df.withColumns({p: parts[p] for p in partition}) if "time" in df.columns and partition else df
    if not partition:
        out.write.mode(mode).parquet(path)
        return path
    order = [*partition, *(c for c in KEYS if c in df.columns)]
    ranges = files or max(1, math.ceil(out.count() / max(rows_per_file, ROWS_PER_RANGE)))
    most = rows_per_file if not files and rows_per_file < ROWS_PER_RANGE else 2 * rows_per_file
    out = out.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    out.write.mode(mode).option("maxRecordsPerFile", most).partitionBy(*partition).parquet(path)
    return path


def wave_view(lineitem: DataFrame) -> DataFrame:
    """Observations (with overlaps) derived from the ``lineitem`` table by arithmetic alone."""
    month = F.month("l_shipdate")
    season = F.when(month.isin(12, 1, 2), 1.25).when(month.isin(6, 7, 8), 0.75).otherwise(1.0)
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    height = F.when((s % 10 == 7) | (k % 53 == 0), None).otherwise((F.col("l_quantity") / 8.0) * ((3 + s % 4) / 4.0) * season)
    t = 4.0 + F.round(F.col("l_tax") * 100.0) * 0.25
    base = lineitem.select("*", height.alias("H"), t.alias("T"))
    h, t = F.col("H"), F.col("T")
    return base.select(
        (F.col("l_shipdate") + F.make_interval(hours=3 * F.col("l_linenumber"))).alias("time"),
        (46.0 + (s % 25) / 5.0).alias("latitude"),
        (-130.0 + F.floor(s / 25) / 5.0).alias("longitude"),
        h.alias("VHM0"), t.alias("VTM02"), (t + 0.5).alias("VTM10"),
        F.when(p % 101 == 0, 0.0).otherwise(t + 1.0).alias("VTPK"),
        (p % 365).cast("double").alias("VMDR"), (p * 3 % 361).cast("double").alias("VPED"),
        (p * 7 % 361).cast("double").alias("VMDR_SW1"), (p * 11 % 361).cast("double").alias("VMDR_SW2"), (p * 13 % 361).cast("double").alias("VMDR_WW"),
        (h * 0.75).alias("VHM0_SW1"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") == 50), None).otherwise(h * 0.25).alias("VHM0_SW2"),
        F.when(k % 211 == 0, -1.0).otherwise(h * 0.5).alias("VHM0_WW"),
        (t + 2.0).alias("VTM01_SW1"), (t + 1.5).alias("VTM01_SW2"), (t - 1.0).alias("VTM01_WW"),
        ((F.round(F.col("l_discount") * 100.0) - 5.0) / 64.0).alias("VSDX"), ((F.round(F.col("l_tax") * 100.0) - 4.0) / 64.0).alias("VSDY"),
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
    )


#: Which of several rows for one time and cell counts.
TIE_BREAK = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"]
