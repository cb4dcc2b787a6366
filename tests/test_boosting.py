"""Histogram boosting and forests against a plain version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from swellgrid.plans import boosting

SCHEMA = "id int, fold int, train boolean, a double, b double, target double"


def made_rows(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.uniform(-3, 3), rng.choice([None, 0.0, 1.0, 2.0])
        y = 4 * (a > 0.5) + (b or 0) * 1.5 + 2 * (a < -1 and b == 1.0) + rng.uniform(-0.2, 0.2)
        rows.append((i, rng.choice([1, 2]), rng.random() < 0.7, a, b, None if i % 97 == 5 else y))
    return rows


def slot(x, lo, hi, bins):
    if x is None or not (lo is not None and hi > lo):
        return bins
    return min(max(math.floor((x - lo) / ((hi - lo) / bins)), 0), bins - 1)


def plain_tree(rows, depth, rate):
    """Leaf of each row of (bins, residual, in training), by plain recursion."""
    train = [i for i, r in enumerate(rows) if r[2]]
    out = {}

    def mean(idx):
        return math.floor(float(sum(rows[i][1] for i in idx)) / len(idx) * rate)

    def down(all_, own, left, leaf):
        best = None
        if left:
            for f in range(len(rows[0][0])):
                for b in sorted({rows[i][0][f] for i in own})[:-1]:
                    low = [rows[i][1] for i in own if rows[i][0][f] <= b]
                    high = [rows[i][1] for i in own if rows[i][0][f] > b]
                    gain = float(sum(low)) ** 2 / len(low) + float(sum(high)) ** 2 / len(high)
                    if best is None or gain > best[0]:
                        best = gain, f, b
        if best is None:
            out.update(dict.fromkeys(all_, leaf))
            return
        _, f, b = best
        for side in (True, False):
            mine = [i for i in own if (rows[i][0][f] <= b) == side]
            down([i for i in all_ if (rows[i][0][f] <= b) == side], mine, left - 1, mean(mine))

    down(list(range(len(rows))), train, depth, mean(train) if train else 0)
    return out


@pytest.mark.parametrize("depth", [1, 3])
def test_boosting_equals_plain_version(spark, depth):
    rows = made_rows(depth)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    binned = boosting.with_bins(df, ["a", "b"], "fold", bins=8).withColumn("y", boosting.fixed(F.col("target")))
    model = boosting.fit_boosted(binned, "y", "fold", trees=4, depth=depth, rate=0.5)
    got = {r["id"]: r["p"] for r in binned.select("id", model.predict("fold").alias("p")).collect()}
    for fold in (1, 2):
        own = [r for r in rows if r[1] == fold]
        spans = [(min(v), max(v)) for k in (3, 4) for v in [[r[k] for r in own if r[2] and r[k] is not None]]]
        bins = [tuple(slot(r[3 + k], *spans[k], 8) for k in range(2)) for r in own]
        y = [None if r[5] is None else math.floor(r[5] * 65536.0 + 0.5) for r in own]
        p = [0] * len(own)
        for _ in range(4):
            leaf = plain_tree([(b, (t or 0) - q, r[2] and t is not None) for b, t, q, r in zip(bins, y, p, own)], depth, 0.5)
            p = [q + leaf[i] for i, q in enumerate(p)]
        assert {r[0]: q for r, q in zip(own, p)} == {r[0]: got[r[0]] for r in own}


def test_boosting_and_forest_beat_the_mean_on_unseen_rows(spark):
    rows = [(i, 1, t, a, b, y) for i, _, t, a, b, y in made_rows(9, 900) if y is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    binned = boosting.with_bins(df, ["a", "b"], "fold").withColumn("y", boosting.fixed(F.col("target"))).withColumn("still", boosting.fixed(F.lit(sum(r[5] for r in rows) / len(rows))))
    unseen = binned.where("NOT train")
    boosted = unseen.withColumn("p", boosting.fit_boosted(binned, "y", "fold", trees=12, depth=3).predict("fold"))
    assert boosting.rmse_gain(boosted, "y", "p", "still", "fold").first()["improvement_percent"] > 75
    forest = boosting.fit_forest(binned, "y", ["id"], trees=8, depth=4)
    assert len(forest.leaves) == 8 and len({tuple(sorted(s.items())) for s in forest.splits.values()}) > 1
    trees = unseen.withColumn("p", boosting.forest_prediction(forest))
    assert boosting.rmse_gain(trees, "y", "p", "still", "fold").first()["improvement_percent"] > 60


def test_constant_missing_and_absent_rows(spark):
    rows = [(1, 1, True, 5.0, None, 2.0), (2, 1, True, 5.0, None, 4.0), (3, 1, False, None, 1.0, 9.0), (4, 2, False, 1.0, 1.0, 1.0)]
    binned = boosting.with_bins(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "fold").withColumn("y", boosting.fixed(F.col("target")))
    assert {r["id"] for r in binned.collect()} == {1, 2, 3}  # a fold without training rows has no spans, and no model
    model = boosting.fit_boosted(binned, "y", "fold", trees=2, depth=2, rate=1.0)
    assert {r["p"] for r in binned.select(model.predict("fold").alias("p")).collect()} == {3 * 65536}
    none = boosting.fit_boosted(binned.where("1 = 0"), "y", "fold", trees=1)
    assert {r["p"] for r in binned.select(none.predict("fold").alias("p")).collect()} == {0}
    assert boosting.fit_forest(binned.where("1 = 0"), "y", ["id"], trees=2).leaves == {}


def test_boosted_folds_returns_its_few_rows_and_holds_nothing(spark):
    from swellgrid.plans.queries import boosted_folds

    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = boosted_folds(spark, "/root/testdata/sf0.001")
    assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 4
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_boosted_forecast_computes_its_rows_once(spark, monkeypatch):
    from swellgrid.plans import queries

    sf_dir = "/root/testdata/sf0.001"
    wanted = {tuple(r)[:3]: r["observed"] for r in queries.lag_forecast(spark, sf_dir).collect()}
    read, raw = spark.sparkContext.accumulator(0), queries.raw

    @F.udf("bigint")
    def counted(key):
        read.add(1)
        return key

    monkeypatch.setattr(queries, "raw", lambda *a: raw(*a).withColumn("l_orderkey", counted("l_orderkey")))
    rows = queries.boosted_forecast(spark, sf_dir).collect()
    assert read.value == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert len(rows) == len(wanted) and {tuple(r)[:3]: r["observed"] for r in rows} == wanted and all(r["predicted"] is not None for r in rows)
