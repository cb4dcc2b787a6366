"""De-duplication of overlapping chunks, work plans and what is left of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import KEYS


def dedup_observations(df: DataFrame, order: Sequence[str] = (), keys: Sequence[str] = KEYS, dealt: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the first by ``order``, or any where the copies are equal.

    Rows are dealt out once, by a hash of ``dealt`` (some of the keys, all by default), and ordered in their tasks, hash first;
    so the shuffle grows with the rows, however many keys are repeated.  What sums by ``dealt`` afterwards finds its
    rows together and shuffles sums only; these columns should have many values, as cells have.  Null keys are equal.
    """
    if not order:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys and c not in order]
    deal = F.xxhash64(*(dealt or keys))
    place = F.row_number().over(Window.partitionBy("deal_", *keys).orderBy(*order))
    settled = df.repartition(deal).withColumn("deal_", deal).withColumn("place_", place)
    return settled.where("place_ = 1").select(*keys, *rest)


def _unit_start(first: Column, k: Column) -> Column:
    """Start of the k-th unit: the first one's own, later ones on its day but no later than the 28th."""
    clamped = F.when(F.day(first) > 28, first - F.make_interval(days=F.day(first) - 28)).otherwise(first)
    return F.when(k == 0, first).otherwise(clamped + F.make_interval(months=k))


def _unit_name(start: Column, end: Column) -> Column:
    return F.concat_ws("_", F.date_format(start, "yyyyMMdd"), F.date_format(end, "yyyyMMdd"))


def chunk_plan(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Monthly work units from ``start`` to ``end``: the day is kept up to the 28th, the last unit ends at ``end``."""
    first = F.lit(start).cast("timestamp_ntz")
    last = F.lit(end).cast("timestamp_ntz")
    months = F.sequence(F.lit(0), F.months_between(F.trunc(last, "month"), F.trunc(first, "month")).cast("int"))
    starts = spark.range(1).select(F.explode(months).alias("m"), last.alias("last")).withColumn("chunk_start", _unit_start(first, F.col("m"))).where("chunk_start < last")
    following = F.lead("chunk_start").over(Window.orderBy("chunk_start"))  # a few hundred rows: one per month
    plan = starts.withColumn("chunk_end", F.coalesce(following, "last"))
    return plan.select(_unit_name(F.col("chunk_start"), F.col("chunk_end")).alias("chunk_name"), "chunk_start", "chunk_end")


def unit_of(time: Column, start: str, end: str) -> Column:
    """Name of the work unit of ``chunk_plan(start, end)`` that a time falls in, by arithmetic; null outside the plan."""
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    month = (F.year(time) - F.year(first)) * 12 + F.month(time) - F.month(first)
    k = F.when(time < _unit_start(first, month), month - 1).otherwise(month)
    return F.when((time >= first) & (time < last), _unit_name(_unit_start(first, k), F.least(_unit_start(first, k + 1), last)))


def pending_chunks(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Units that the ledger doesn't list."""
    return plan.join(ledger.select("chunk_name"), "chunk_name", "left_anti")
