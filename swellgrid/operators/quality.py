"""Quality control: masks, completeness, ranges, coverage and histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CELL, KEYS, QUALITY_LIMITS, VARIABLES
from ..sources.axes import Axes


def passes_quality(limits: dict[str, tuple[float, float, bool]] = QUALITY_LIMITS) -> Column:
    """Whether all range tests hold; a missing value fails."""

    def test(name: str, low: float, high: float, strict: bool) -> Column:
        c = F.col(name)
        return (c > low if strict else c >= low) & (c <= high)

    return F.coalesce(reduce(lambda a, b: a & b, (test(n, *limit) for n, limit in limits.items())), F.lit(False))


def mask_failed(df: DataFrame, variables: Sequence[str] = VARIABLES) -> DataFrame:
    """Every row stays, but where a test fails all variables are missing."""
    ok = passes_quality()
    return df.select(*KEYS, *[F.when(ok, F.col(c)).alias(c) for c in variables])


def drop_failed(df: DataFrame) -> DataFrame:
    return df.where(passes_quality())


def pass_rate(df: DataFrame) -> DataFrame:
    """Rows, rows that pass and their share in percent."""
    ok = passes_quality().cast("long")
    return df.agg(F.count("*").alias("n_rows"), F.sum(ok).alias("n_pass"), (F.try_divide(F.sum(ok).cast("double"), F.count("*").cast("double")) * 100).alias("pass_percent"))


def missing_percent(df: DataFrame, variables: Sequence[str] = VARIABLES) -> DataFrame:
    """Share of missing values per variable, from one pass over all of them."""
    n = F.count("*")
    share = [F.struct(F.lit(v).alias("variable"), (F.try_divide((n - F.count(v)).cast("double"), n.cast("double")) * 100).alias("missing_percent")) for v in variables]
    return df.agg(F.array(*share).alias("s")).select(F.inline("s"))


def value_ranges(df: DataFrame, variables: Sequence[str] = VARIABLES) -> DataFrame:
    """Smallest and largest value per variable, from one pass."""
    both = [F.struct(F.lit(v).alias("variable"), F.min(v).alias("min_value"), F.max(v).alias("max_value")) for v in variables]
    return df.agg(F.array(*both).alias("s")).select(F.inline("s"))


def land_ocean(df: DataFrame, variable: str = "VHM0") -> DataFrame:
    """Cells with and without a value at their first time step; failed cells count as land."""
    first = df.groupBy(*CELL).agg(F.min_by(F.struct(variable), "time").alias("s"))
    n, ocean = F.count("*"), F.count(f"s.{variable}")
    return first.agg(
        n.alias("n_cells"), ocean.alias("n_ocean"), (n - ocean).alias("n_land"),
        (F.try_divide(ocean.cast("double"), n.cast("double")) * 100).alias("ocean_percent"),
    )


def never_valid(df: DataFrame, variable: str = "VHM0") -> DataFrame:
    """Cells that hold no value at any time: the stricter reading of land."""
    return df.groupBy(*CELL).agg(F.count(variable).alias("n")).where("n = 0").select(*CELL)


def histogram(df: DataFrame, variable: str, bins: int = 50) -> DataFrame:
    """Counts of ``bins`` equal bins from minimum to maximum, the last one closed; empty bins count 0."""
    x = F.col(variable)
    spread = df.agg(F.min(variable).alias("lo"), F.max(variable).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((x - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = df.where(x.isNotNull()).select(variable).crossJoin(F.broadcast(spread)).groupBy(slot.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(spread)).where("lo IS NOT NULL")
    edges = edges.select("bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"))
    return edges.join(counts, "bin", "left").select("bin", "bin_start", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def final_summary(df: DataFrame, variables: Sequence[str] = VARIABLES, axes: Axes | None = None) -> DataFrame:
    """Shape, time span, bounds and the plain mean of the variables' missing shares, one row.

    With the rows' axis catalogue the shape comes from there; else three distinct counts multiply the rows.
    """
    n = F.count("*").cast("double")
    missing = reduce(lambda a, b: a + b, [F.try_divide(n - F.count(v), n) * 100 for v in variables]) / len(variables)
    sizes = axes.shape() if axes else {}
    counts = [F.any_value(F.lit(sizes[c]).cast("bigint")) if axes else F.count_distinct(c) for c in KEYS]
    return df.agg(
        *[c.alias(n) for c, n in zip(counts, ("n_times", "n_lats", "n_lons"), strict=True)],
        F.date_diff(F.max("time"), F.min("time")).alias("span_days"),
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"), F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
        missing.alias("mean_missing_percent"),
    )
