"""Two sources on their own grids and clocks brought together: bilinear weights in space, the nearest step within a tolerance in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CELL, KEYS

_NEAR = 1e-9  # of a grid step: closer points are on the line


def _corners(axis: str, step: float) -> tuple[Column, Column]:
    """Index of the grid line at or below a value, and how far beyond it the value is, in steps."""
    at = F.col(axis) / step
    line = F.floor(at + _NEAR)
    return line, F.greatest(F.round(at - line, 9), F.lit(0.0))


def bilinear(field: DataFrame, value: str, targets: DataFrame, step: float, time: str = "time") -> DataFrame:
    """(time, latitude, longitude, value): a gridded field (time, latitude, longitude, value) at the distinct cells of ``targets``.

    The grid's lines are the multiples of ``step``.  A target has a value at a time if all nodes that weigh in have one:
    four within a mesh, two on a line, one on a node.  Targets meet nodes by an equality of grid indices; a node serves the few targets
    around it, so rows grow by a constant.
    """
    (i, y), (j, x) = _corners("latitude", step), _corners("longitude", step)
    cells = targets.select(*CELL).dropna().distinct().select(*CELL, i.alias("i"), y.alias("y"), j.alias("j"), x.alias("x"))
    weights = [(a, b, (F.col("y") if a else 1 - F.col("y")) * (F.col("x") if b else 1 - F.col("x"))) for a in (0, 1) for b in (0, 1)]
    corners = F.array(*[F.struct((F.col("i") + a).alias("node_i"), (F.col("j") + b).alias("node_j"), w.alias("weight")) for a, b, w in weights])
    needed = F.filter(corners, lambda c: c["weight"] > 0)
    meshes = cells.select(*CELL, F.size(needed).alias("needed"), F.inline(needed))
    nodes = field.where(F.col(value).isNotNull()).select(
        time, F.round(F.col("latitude") / step).cast("bigint").alias("node_i"), F.round(F.col("longitude") / step).cast("bigint").alias("node_j"), F.col(value).alias("node_value")
    )
    found = nodes.join(meshes, ["node_i", "node_j"]).groupBy(time, *CELL).agg(F.sum(F.col("weight") * F.col("node_value")).alias(value), F.count("*").alias("n"), F.first("needed").alias("needed"))
    return found.where("n = needed").select(time, *CELL, value)


def nearest_in_time(left: DataFrame, right: DataFrame, by: Sequence[str], tolerance_seconds: int, time: str = "time") -> DataFrame:
    """Rows of ``left`` with the columns of the row of ``right`` of the same ``by`` that is nearest in time, ``matched_time`` and its distance in seconds.

    No farther than ``tolerance_seconds``; of two equally near the earlier counts; rows without a match go.  Each side has a
    row for each ``by`` and time.  Times are dealt into buckets as wide as the tolerance and a right row into its
    own and both neighbours, so it is an equi-join that no long series makes quadratic.
    """
    def seconds(c: Column) -> Column:
        return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)

    bucket = F.floor(seconds(F.col(time)) / tolerance_seconds)
    rest = [c for c in right.columns if c not in (*by, time)]
    there = right.where(F.col(time).isNotNull()).select(*by, F.col(time).alias("matched_time"), *rest, F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    apart = F.abs(seconds(F.col("matched_time")) - seconds(F.col(time)))
    pairs = left.withColumn("bucket", bucket).join(there, [*by, "bucket"]).withColumn("seconds_apart", apart).where(F.col("seconds_apart") <= tolerance_seconds)
    own = [c for c in left.columns if c not in (*by, time)]
    best = F.min(F.struct("seconds_apart", "matched_time", *own, *rest)).alias("best")
    return pairs.groupBy(*by, time).agg(best).select(*by, time, *[F.col(f"best.{c}").alias(c) for c in (*own, "matched_time", "seconds_apart", *rest)])


def compare_sources(observed: DataFrame, modelled: DataFrame, value: str, step: float, tolerance_seconds: int) -> DataFrame:
    """(latitude, longitude, n, bias, rmse, mean_seconds_apart) by observed cell: a modelled field on a grid of ``step`` against observations of another grid and clock.

    Several observations of one cell and time count with their mean.
    """
    once = observed.where(F.col(value).isNotNull()).groupBy(*KEYS).agg(F.avg(value).alias("observed_"))
    field = bilinear(modelled, value, once, step).withColumnRenamed(value, "modelled_")
    both = nearest_in_time(once, field, CELL, tolerance_seconds)
    d = F.col("modelled_") - F.col("observed_")
    return both.groupBy(*CELL).agg(F.count("*").alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg("seconds_apart").alias("mean_seconds_apart"))
