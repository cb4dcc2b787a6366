"""Gradient boosting and forests by histograms: one grouped sum over binned features for each level of the trees.

Targets and leaves are whole multiples of 2^-16, so that every sum is exact, whatever the order of rows, and a model comes
out the same on any cluster.  Models of several groups (folds of a validation, trees of a forest) grow in the same jobs.
Only histograms come to the driver: groups x nodes x features x bins rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Hashable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.observations import reused

UNIT = 65536
BINS, TREES, DEPTH, RATE = 32, 20, 3, 0.5

Group = Hashable


def fixed(value: Column) -> Column:
    """A double as whole units of 2^-16, halves upwards."""
    return F.floor(value * float(UNIT) + 0.5)


def with_bins(df: DataFrame, inputs: Sequence[str], group: str, train: str = "train", bins: int = BINS) -> DataFrame:
    """Add ``bins``: for each of ``inputs`` which of ``bins`` equal slices of the span of the group's training rows it is in.

    Values outside the span are in the end slices, a missing one has the number ``bins`` to itself; so has every row where
    the training rows have no span.
    """
    spans = df.where(train).groupBy(group).agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(inputs) for n, f in (("lo", F.min), ("hi", F.max))])

    def slot(i: int, c: str) -> Column:
        lo, hi = F.col(f"lo_{i}"), F.col(f"hi_{i}")
        inside = F.floor((F.col(c) - lo) / ((hi - lo) / bins))
        return F.coalesce(F.when((hi > lo) & F.col(c).isNotNull(), F.least(F.greatest(inside, F.lit(0)), F.lit(bins - 1))), F.lit(bins)).cast("int")

    kept = df.columns
    return df.join(spans, group).select(*kept, F.array(*[slot(i, c) for i, c in enumerate(inputs)]).alias("bins"))


@dataclass
class Trees:
    """One tree for each group: splits (feature, last bin on the low side) and leaves by node; node k has children 2k and 2k + 1."""

    splits: dict[Group, dict[int, tuple[int, int]]] = field(default_factory=lambda: defaultdict(dict))
    leaves: dict[Group, dict[int, int]] = field(default_factory=lambda: defaultdict(dict))

    def node(self, group: str) -> Column:
        """The node that a row is in."""
        return self._walk(group, lambda _, k: F.lit(k))

    def value(self, group: str) -> Column:
        """The leaf of a row, in units; 0 in a group without a tree."""
        return self._walk(group, lambda g, k: F.lit(self.leaves.get(g, {}).get(k, 0)).cast("bigint"))

    def _walk(self, group: str, at) -> Column:
        def down(g: Group, k: int) -> Column:
            if k not in self.splits.get(g, {}):
                return at(g, k)
            feature, low = self.splits[g][k]
            return F.when(F.get("bins", F.lit(feature)) <= low, down(g, 2 * k)).otherwise(down(g, 2 * k + 1))

        out = at(None, 1)
        for g in list(self.leaves):
            out = F.when(F.col(group) == F.lit(g), down(g, 1)).otherwise(out)
        return out


def best_split(histogram: dict[int, dict[int, tuple[int, int]]]) -> tuple[int, int, tuple[int, int], tuple[int, int]] | None:
    """(feature, last low bin, low (sum, n), high (sum, n)) of the largest S^2 / n on both sides; of equal ones the first feature and bin.

    ``histogram`` has (sum, n) by feature and bin; None if no split has rows on both sides.
    """
    best, found = None, None
    for feature in sorted(histogram):
        bins = histogram[feature]
        total, n = sum(s for s, _ in bins.values()), sum(c for _, c in bins.values())
        low, n_low = 0, 0
        for b in sorted(bins)[:-1]:
            low, n_low = low + bins[b][0], n_low + bins[b][1]
            high, n_high = total - low, n - n_low
            gain = float(low) * float(low) / n_low + float(high) * float(high) / n_high
            if best is None or gain > best:
                best, found = gain, (feature, b, (low, n_low), (high, n_high))
    return found


def grow(rows: DataFrame, group: str, residual: Column, depth: int, rate: float) -> Trees:
    """A tree of at most ``depth`` levels for each group of ``rows`` (group, bins) by least squares on ``residual``; leaves are means times ``rate``."""
    trees = Trees()
    for level in range(depth):
        placed = rows.select(group, trees.node(group).alias("node"), residual.alias("r"), F.posexplode("bins").alias("feature", "bin"))
        if level:
            placed = placed.where(F.col("node") >= 2**level)  # a leaf of a level above is finished
        sums = placed.groupBy(group, "node", "feature", "bin").agg(F.sum("r").alias("s"), F.count("*").alias("n")).collect()
        histograms: dict[tuple[Group, int], dict[int, dict[int, tuple[int, int]]]] = defaultdict(lambda: defaultdict(dict))
        for r in sums:
            histograms[r[group], r["node"]][r["feature"]][r["bin"]] = (r["s"], r["n"])
        for (g, k), histogram in histograms.items():
            if not level:
                s, n = (sum(x) for x in zip(*histogram[0].values(), strict=True))
                trees.leaves[g][k] = _leaf(s, n, rate)
            split = best_split(histogram)
            if split:
                feature, low_bin, low, high = split
                trees.splits[g][k] = feature, low_bin
                trees.leaves[g] |= {2 * k: _leaf(*low, rate), 2 * k + 1: _leaf(*high, rate)}
        if not histograms:
            break
    return trees


def _leaf(s: int, n: int, rate: float) -> int:
    return int(float(s) / n * rate // 1)


@dataclass
class Boosted:
    """Trees whose leaves add up; of a forest, the mean of a tree for each group."""

    trees: list[Trees]

    def predict(self, group: str) -> Column:
        """Prediction in units."""
        out = F.lit(0).cast("bigint")
        for t in self.trees:
            out = out + t.value(group)
        return out


def fit_boosted(binned: DataFrame, target: str, group: str, train: str = "train", trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boosted:
    """Boosted trees for each group of ``binned`` (see ``with_bins``), fitted to the units in ``target`` of its training rows.

    The training rows are held for the passes, one for each level of each tree.  Rows without a target count for nothing; a
    group without training rows predicts 0.
    """
    model = Boosted([])
    with reused(binned.where(F.col(train) & F.col(target).isNotNull()).select(group, "bins", target)) as rows:
        for _ in range(trees):
            model.trees.append(grow(rows, group, F.col(target) - model.predict(group), depth, rate))
    return model


def fit_forest(binned: DataFrame, target: str, row_key: Sequence[str], train: str = "train", trees: int = TREES, depth: int = DEPTH, share: float = 0.6, seed: int = 1) -> Trees:
    """``trees`` trees, each on the training rows of which a seeded hash of ``row_key`` and the tree draws a ``share``; all of them grow in the same passes."""
    drawn = F.pmod(F.xxhash64(F.lit(seed), "tree", *row_key), F.lit(1 << 20)) < int(share * (1 << 20))
    copies = binned.where(F.col(train) & F.col(target).isNotNull()).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(drawn)
    with reused(copies.select("tree", "bins", target)) as rows:
        return grow(rows, "tree", F.col(target), depth, 1.0)


def forest_prediction(forest: Trees) -> Column:
    """Mean of the leaves of all trees in units, as a double."""

    def down(g: Group, k: int = 1) -> Column:
        if k not in forest.splits[g]:
            return F.lit(forest.leaves[g][k]).cast("bigint")
        feature, low = forest.splits[g][k]
        return F.when(F.get("bins", F.lit(feature)) <= low, down(g, 2 * k)).otherwise(down(g, 2 * k + 1))

    grown = [down(g) for g in sorted(forest.leaves)]
    return sum(grown[1:], grown[0]) / len(grown) if grown else F.lit(0.0)


def rmse_gain(tested: DataFrame, target: str, predicted: str, persistence: str, group: str) -> DataFrame:
    """Root mean square errors of a model and of persistence (columns in units) by group, and the improvement in percent; exact sums of squares."""

    def rmse(c: str) -> Column:
        miss = (F.col(target) - F.col(c)).cast("decimal(19,0)")
        return F.sqrt(F.sum(miss * miss).cast("double") / F.count("*")) / UNIT

    model, still = rmse(predicted), rmse(persistence)
    return tested.groupBy(group).agg(F.count("*").alias("n_test"), model.alias("rmse_model"), still.alias("rmse_persistence"), (100 * (1 - F.try_divide(model, still))).alias("improvement_percent"))
