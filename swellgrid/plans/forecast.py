"""Lag forecasts for every site in one job, with scores, baselines and extensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.aggregate import grouped_percentiles
from ..schema import CELL

TRAIN_SHARE = 0.7


def lag_features(monthly: DataFrame, value: str, time: str = "month_end", lags: int = 1) -> DataFrame:
    """Rows with the ``lags`` previous values of their site; lags count rows, gaps stay.  Rows without all lags go."""
    order = Window.partitionBy(*CELL).orderBy(time)
    out = monthly.select(*CELL, time, value)
    for k in range(1, lags + 1):
        out = out.withColumn("lag1" if k == 1 else f"lag{k}", F.lag(value, k).over(order))
    return out.dropna()


def split_by_time(features: DataFrame, time: str = "month_end", share: float = TRAIN_SHARE) -> DataFrame:
    """Add ``row`` and ``train``: the first ``int(n * share)`` rows of each site by time train."""
    site = Window.partitionBy(*CELL)
    n = F.count("*").over(site).cast("double")
    return features.withColumn("row", F.row_number().over(site.orderBy(time))).withColumn("train", F.col("row") <= F.floor(n * F.lit(share)))


def fit_lag(split: DataFrame, value: str) -> DataFrame:
    """Least squares of value on lag1 over the training rows of each site; a constant lag gives slope 0."""
    train = split.where("train")
    flat = F.var_pop("lag1") == 0
    return train.groupBy(*CELL).agg(
        F.when(flat, 0.0).otherwise(F.regr_slope(value, "lag1")).alias("slope"),
        F.when(flat, F.avg(value)).otherwise(F.regr_intercept(value, "lag1")).alias("intercept"),
        F.count("*").alias("n_train"),
    )


def predict(split: DataFrame, fits: DataFrame) -> DataFrame:
    """Test rows with the prediction of their site's model."""
    return split.where("NOT train").join(fits, CELL).withColumn("predicted", F.col("intercept") + F.col("slope") * F.col("lag1"))


def score(predicted: DataFrame, value: str) -> DataFrame:
    """Mean absolute error and R2 per site over test rows; R2 is null with a constant or single target."""
    y, p = F.col(value), F.col("predicted")
    total = F.var_pop(y) * F.count(y)
    return predicted.groupBy(*CELL).agg(
        F.count("*").alias("n_test"), F.avg(F.abs(y - p)).alias("mae"), F.when((F.count(y) > 1) & (total > 0), 1 - F.sum((y - p) * (y - p)) / total).alias("r2")
    )


def persistence_gain(predicted: DataFrame, value: str) -> DataFrame:
    """Root mean square errors of the model and of persistence, and the improvement in percent."""
    y = F.col(value)
    model = F.sqrt(F.avg((y - F.col("predicted")) * (y - F.col("predicted"))))
    still = F.sqrt(F.avg((y - F.col("lag1")) * (y - F.col("lag1"))))
    return predicted.groupBy(*CELL).agg(model.alias("rmse_model"), still.alias("rmse_persistence"), (100 * (1 - F.try_divide(model, still))).alias("improvement_percent"))


def collocate(observed: DataFrame, modelled: DataFrame, value: str, step: float = 0.25) -> DataFrame:
    """Bias and RMSE per cell of a coarser grid: both sides snap to integer grid indices and join on time."""

    def snapped(df: DataFrame, name: str) -> DataFrame:
        i, j = (F.round(F.col(c) / step).cast("int") for c in CELL)
        return df.groupBy("time", i.alias("lat_idx"), j.alias("lon_idx")).agg(F.avg(value).alias(name))

    both = snapped(observed, "obs").join(snapped(modelled, "mod"), ["time", "lat_idx", "lon_idx"]).dropna()
    d = F.col("mod") - F.col("obs")
    return both.groupBy("lat_idx", "lon_idx").agg(F.count("*").alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"))


def season_and_neighbours(monthly: DataFrame, value: str, time: str = "month_end", step: float = 0.2, lags: int = 2) -> DataFrame:
    """The ``lags`` previous values of the site (null where there is none), month sine and cosine, and the mean of the eight neighbouring cells in the same month."""
    order = Window.partitionBy(*CELL).orderBy(time)
    before = [F.lag(value, k).over(order).alias(f"lag{k}") for k in range(1, lags + 1)]
    base = monthly.select(*CELL, time, value, F.round(F.col("latitude") / step).cast("int").alias("i"), F.round(F.col("longitude") / step).cast("int").alias("j"))
    offsets = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    shifted = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets]))
    around = base.select(time, "i", "j", value, shifted.alias("o")).groupBy(time, (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j")).agg(F.avg(value).alias("neighbour_mean"))
    turn = 2 * F.pi() * F.month(time) / 12
    lagged = base.select("*", *before)
    return lagged.join(around, [time, "i", "j"], "left").select(*CELL, time, value, *[f"lag{k}" for k in range(1, lags + 1)], F.sin(turn).alias("month_sin"), F.cos(turn).alias("month_cos"), "neighbour_mean")


def expanding_folds(features: DataFrame, folds: int = 4, time: str = "month_end") -> DataFrame:
    """Rows by fold and role: fold k trains on the first k of ``folds + 1`` blocks of its site and tests on the next."""
    order = Window.partitionBy(*CELL).orderBy(time)
    blocks = features.withColumn("block", F.ntile(folds + 1).over(order))
    spread = blocks.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    return spread.where("block <= fold + 1").withColumn("train", F.col("block") <= F.col("fold"))


def fold_scores(folded: DataFrame, value: str) -> DataFrame:
    """Mean absolute error of the lag model per site and fold."""
    flat = F.var_pop("lag1") == 0
    fits = folded.where("train").groupBy(*CELL, "fold").agg(
        F.when(flat, 0.0).otherwise(F.regr_slope(value, "lag1")).alias("slope"), F.when(flat, F.avg(value)).otherwise(F.regr_intercept(value, "lag1")).alias("intercept")
    )
    tested = folded.where("NOT train").join(fits, [*CELL, "fold"])
    return tested.groupBy(*CELL, "fold").agg(F.count("*").alias("n_test"), F.avg(F.abs(F.col(value) - F.col("intercept") - F.col("slope") * F.col("lag1"))).alias("mae"))


def multi_horizon(monthly: DataFrame, value: str, horizons: Sequence[int] = (1, 2, 3), time: str = "month_end") -> DataFrame:
    """Slope and intercept of the value ``h`` rows ahead on the present one, per site and horizon."""
    order = Window.partitionBy(*CELL).orderBy(time)
    leads = [F.struct(F.lit(h).alias("horizon"), F.lead(value, h).over(order).alias("target")) for h in horizons]
    pairs = monthly.select(*CELL, F.col(value).alias("x"), F.array(*leads).alias("l")).select(*CELL, "x", F.inline("l")).dropna()
    flat = F.var_pop("x") == 0
    return pairs.groupBy(*CELL, "horizon").agg(
        F.count("*").alias("n"),
        F.when(flat, 0.0).otherwise(F.regr_slope("target", "x")).alias("slope"),
        F.when(flat, F.avg("target")).otherwise(F.regr_intercept("target", "x")).alias("intercept"),
    )


def extreme_events(df: DataFrame, value: str, percentile: float = 0.95, max_gap_hours: int = 72) -> DataFrame:
    """Runs of values above the cell's own percentile; a gap of more than ``max_gap_hours`` ends a run."""
    limits = grouped_percentiles(df, CELL, value, {"threshold": percentile})
    high = df.join(limits, CELL).where(F.col(value) > F.col("threshold"))
    order = Window.partitionBy(*CELL).orderBy("time")
    gap = F.timestamp_diff("HOUR", F.lag("time").over(order), F.col("time"))
    runs = high.withColumn("starts", F.when(gap <= max_gap_hours, 0).otherwise(1)).withColumn("event", F.sum("starts").over(order))
    return runs.groupBy(*CELL, "event").agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count("*").alias("n"), F.max(value).alias("peak"))


def ensemble_spread(members: DataFrame, value: str, keys: Sequence[str] = ("time", *CELL)) -> DataFrame:
    """Mean, sample deviation and 10/90 percentiles over ensemble members."""
    return members.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("spread"), F.percentile(value, 0.1).alias("p10"), F.percentile(value, 0.9).alias("p90")
    )


def boosted_trees(features: DataFrame, value: str, inputs: Sequence[str] = ("lag1",), trees: int = 20, depth: int = 4, seed: int = 1, forest: bool = False):
    """A fitted gradient-boosted (or random forest) regressor over the rows of all sites."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    assembler = VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="skip")
    model = (
        RandomForestRegressor(labelCol=value, numTrees=trees, maxDepth=depth, seed=seed)
        if forest
        else GBTRegressor(labelCol=value, maxIter=trees, maxDepth=depth, seed=seed)
    )
    return Pipeline(stages=[assembler, model]).fit(features)
