"""Scores of ensemble forecasts against what was observed: CRPS, rank histogram, spread against skill, exceedance.

An ensemble is a row for each key and member.  The members of a key are brought together once, as a sorted array (as
long as the ensemble is large); all scores are arithmetic on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEYS


def sorted_members(members: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, members): the non-null values of each key, rising."""
    return members.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("members"))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def ensemble_mean(members: Column) -> Column:
    return F.when(F.size(members) > 0, _sum(members) / F.size(members))


def ensemble_variance(members: Column) -> Column:
    """Sample variance; null with fewer than two members."""
    # The mean as the only entry of an array is computed once, not once for each member.
    squares = F.transform(F.array(ensemble_mean(members)), lambda mean: _sum(F.transform(members, lambda x: (x - mean) * (x - mean))))
    return F.when(F.size(members) > 1, F.get(squares, F.lit(0)) / (F.size(members) - 1))


def crps(members: Column, observed: Column, fair: bool = False) -> Column:
    """Continuous ranked probability score of a sorted ensemble: mean |x - y| less half the mean distance of two members.

    With ``fair`` a member is not compared with itself, which makes the score free of the ensemble's size; it
    is null with one member then.  Null without members or observation.
    """
    n = F.size(members)
    miss = _sum(F.transform(members, lambda x: F.abs(x - observed))) / n
    # Sum of |x_i - x_j| over all pairs, from the places i = 0, 1, ... of the sorted members.
    apart = 2 * _sum(F.transform(members, lambda x, i: x * (2 * i + 1 - n)))
    return F.when((n > (1 if fair else 0)) & observed.isNotNull(), miss - apart / (2 * n * ((n - 1) if fair else n)))


def rank_of(members: Column, observed: Column) -> Column:
    """Members below the observation: its place among them, the lowest with ties."""
    return F.when(observed.isNotNull(), F.size(F.filter(members, lambda x: x < observed)))


def score_ensemble(members: DataFrame, observed: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """``score_cases`` of members and observations in tables of their own.

    ``observed`` has each key once; both sides are dealt out by the key, so the members' exchange serves the join too.
    """
    gathered = sorted_members(members, value, keys)
    return score_cases(gathered.join(observed.select(*keys, F.col(value).alias("observed")), list(keys)), keys)


def score_cases(cases: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of keys that have members and an observation: both, n, mean, variance, rank, crps and the square of the mean's error.

    ``cases`` has each key once with its ``members``, an array in any order, and what was ``observed``; nothing is shuffled.
    ``inline`` keeps the sorted members a column of their own: a filter on a score would else be pushed below it, and sort them
    again in each of its terms.
    """
    ready = F.struct(F.array_sort(F.array_compact("members")).alias("members"), F.col("observed"))
    ready = cases.where("observed IS NOT NULL").select(*keys, F.inline(F.array(ready))).where(F.size("members") > 0)
    x, y = F.col("members"), F.col("observed")
    out = ready.select(*keys, "members", "observed", F.size(x).alias("n"), ensemble_mean(x).alias("mean"), ensemble_variance(x).alias("variance"), rank_of(x, y).alias("rank"), crps(x, y).alias("crps"))
    return out.withColumn("squared_error", (F.col("mean") - y) * (F.col("mean") - y))


def rank_histogram(scores: DataFrame) -> DataFrame:
    """(n, rank, count) for every rank from 0 to n of each ensemble size n; a reliable ensemble has even counts."""
    found = scores.groupBy("n", "rank").agg(F.count("*").alias("count"))
    ranks = found.select("n").distinct().select("n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("rank"))
    return ranks.join(found, ["n", "rank"], "left").na.fill(0, ["count"])


def spread_and_skill(scores: DataFrame, width: float) -> DataFrame:
    """By slices of ``width`` of the ensemble's deviation: cases, mean variance and mean squared error (equal for a reliable ensemble), and their ratio."""
    sliced = scores.where("variance IS NOT NULL").withColumn("slice", F.floor(F.sqrt("variance") / width).cast("int"))
    out = sliced.groupBy("slice").agg(F.count("*").alias("cases"), F.avg("variance").alias("mean_variance"), F.avg("squared_error").alias("mean_squared_error"))
    return out.withColumn("ratio", F.try_divide("mean_variance", "mean_squared_error"))


def exceedance(scores: DataFrame, limit: float, bins: int = 10) -> DataFrame:
    """Reliability of the probability to exceed ``limit``: by slice of the forecast probability its mean, the observed share, and the Brier score."""
    p = F.size(F.filter("members", lambda x: x > limit)) / F.size("members")
    happened = F.when(F.col("observed") > limit, 1.0).otherwise(0.0)
    rows = scores.select(p.alias("p"), happened.alias("o")).withColumn("slice", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
    return rows.groupBy("slice").agg(F.count("*").alias("cases"), F.avg("p").alias("forecast"), F.avg("o").alias("observed"), F.avg((F.col("p") - F.col("o")) * (F.col("p") - F.col("o"))).alias("brier"))
