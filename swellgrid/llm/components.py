"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (id, component): each id that has a link, with the smallest id it reaches.

    Every step only takes minima (summed map-side) and joins them back, so a hub is
    never gathered in one task; the minima are written first, which leaves both sides of
    the join to the adaptive skew split.  The steps needed grow with the logarithm of the
    number of ids.  Nulls and self-links are dropped; no links give no rows.
    """
    pairs = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges, seen = _written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "large-star")
        large = both.join(first, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, last = edges, seen
        edges, seen = _written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(before, first, large, low)
        if seen == last:
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The table written, with its rows and the sum of their digests, which are taken while it is written."""
    what = Observation()
    table = materialize(edges.observe(what, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")), "links")
    return table, (what.get["n"], what.get["digest"])
