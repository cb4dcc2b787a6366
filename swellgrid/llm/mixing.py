"""Mixing sources to target weights by hierarchical token budgets.

The budget flows down a tree of columns (domain, language, source).  Among siblings it is
split by weight; what a node can't supply goes to its siblings, and only what a whole family
can't supply goes back to its ancestors (water-filling at each level with the capacities
of the subtrees).  Each leaf then takes a prefix, in tokens, of its seeded epochs: whole
epochs first, then the documents in the order of the next epoch's seeded digest until the
quota is reached.

The prefix of a leaf is found from sums over digest buckets, and exactly only in the
one bucket where it ends, so that no task gathers a leaf however large it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize
from .exact_dedup import with_normalised

#: Hex digits of the digest that make a bucket: 4096 buckets a leaf.
_BUCKET_DIGITS = 3
#: Up to so many leaves (a few MB) the quota table is broadcast; beyond it is joined.
BROADCAST_LEAVES = 50_000


def with_words(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add ``out``: the number of blank-separated words (null text: 0)."""
    df = with_normalised(df, text_col, out).withColumn(out, F.trim(out))
    spaces = F.length(out) - F.length(F.replace(F.col(out), F.lit(" "), F.lit("")))
    return df.withColumn(out, F.when(F.col(out) == "", F.lit(0)).otherwise(spaces + 1).cast("bigint"))


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    """The weight of ``key`` in a small fixed table."""
    if not values:
        return F.lit(float(default))
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, F.coalesce(key, F.lit(""))), F.lit(float(default)))


def split_budget(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``quota`` to nodes (parent columns, ``name``, cap, weight, budget): the share of the parent's budget.

    With siblings by rising cap / weight, the water level is the largest of
    (budget - caps before) / (weights from here on); each gets its weight times that, its cap at most.
    """
    by = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), F.col(name).asc_nulls_first())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = nodes.where("weight > 0").withColumn("level", (F.col("budget") - before) / rest)
    level = F.max("level").over(Window.partitionBy(*parent))
    return levels.withColumn("quota", F.greatest(F.lit(0.0), F.least(F.col("cap"), level * F.col("weight")))).drop("level")


def leaf_quotas(supply: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], budget: float, max_epochs: int, default: float = 1.0) -> DataFrame:
    """(levels..., supply) -> (levels..., supply, quota) in tokens."""
    top = free_name(levels, "all_")
    weight = {n: lookup(weights.get(n, {}), F.col(n), default) for n in levels}
    # What a node of weight 0 holds is no capacity of its ancestors.
    positive = reduce(lambda a, b: a & b, (w > 0 for w in weight.values()))
    caps = supply.withColumn(top, F.lit(0)).withColumn("cap", F.when(positive, F.col("supply").cast("double") * max_epochs).otherwise(0.0))
    given = caps.groupBy(top).agg(F.least(F.sum("cap"), F.lit(float(budget))).alias("budget"))
    path = [top]
    for level in levels:
        nodes = caps.groupBy(*path, level).agg(F.sum("cap").alias("cap")).withColumn("weight", weight[level])
        joined = nodes.alias("n").join(given.alias("g"), [F.col(f"n.{c}").eqNullSafe(F.col(f"g.{c}")) for c in path])
        given = split_budget(joined.select("n.*", "g.budget"), path, level)
        path = [*path, level]
        given = given.select(*path, F.col("quota").alias("budget"))
    out = supply.alias("s").join(given.alias("g"), [F.col(f"s.{c}").eqNullSafe(F.col(f"g.{c}")) for c in levels])
    return out.select("s.*", F.col("g.budget").alias("quota"))


def mix_sources(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, float]],
    budget_share: float = 0.8,
    budget_tokens: int | None = None,
    max_epochs: int = 2,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows of ``docs`` as often as they are selected, with the level columns and ``epoch`` (long, from 0).

    ``levels`` names the tree from the root down; a level that isn't a column of ``docs`` is
    added.  ``weights`` gives the weights of the values at each level (1 for others, 0 drops).
    Tokens are blank-separated words; texts without any have none and come with each epoch
    of their leaf.  The document at which a leaf's quota ends is taken whole, so a leaf
    exceeds its quota by less than one document; rows that repeat its id come with it.  A null
    level value is a value of its own, a null id sorts as the empty string, null text is empty.
    An empty table gives no rows.
    """
    names = list(levels)
    docs = docs.drop("epoch")
    given = docs.withColumns({n: c for n, c in levels.items() if n not in docs.columns})
    key = free_name(given.columns, "id_")
    light = with_words(given.select(*names, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(key), F.col(text_col).alias("tokens_")), "tokens_", "tokens_")
    light = materialize(light, "token-counts")
    supply = materialize(light.groupBy(*names).agg(F.sum("tokens_").cast("bigint").alias("supply")), "supply")
    budget = budget_tokens if budget_tokens is not None else budget_share * (supply.agg(F.sum("supply")).first()[0] or 0)
    quotas = leaf_quotas(supply, names, weights, budget, max_epochs)
    full = F.coalesce(F.floor(F.try_divide("quota", "supply")), F.lit(0))
    quotas = quotas.withColumn("full", full.cast("bigint")).withColumn("rest", F.floor(F.col("quota") - F.col("full") * F.col("supply")).cast("bigint"))
    quotas = materialize(quotas, "quotas")
    small = quotas.count() <= BROADCAST_LEAVES

    def with_leaf(df: DataFrame, leaves: DataFrame) -> DataFrame:
        right = F.broadcast(leaves) if small else leaves
        on = [F.col(f"l.{c}").eqNullSafe(F.col(f"q.{c}")) for c in names]
        return df.alias("l").join(right.alias("q"), on).select("l.*", *[f"q.{c}" for c in leaves.columns if c not in names])

    def digest(id_text: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), id_text).cast("binary"))

    ordered = with_leaf(light, quotas).where("rest > 0").withColumn("digest", digest(F.col(key)))
    ordered = ordered.withColumn("bucket", F.substring("digest", 1, _BUCKET_DIGITS))
    sums = ordered.groupBy(*names, "bucket").agg(F.sum("tokens_").alias("t"), F.first("rest").alias("rest"))
    upto = F.sum("t").over(Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = sums.withColumn("upto", upto).where("upto >= rest").groupBy(*names).agg(F.min(F.struct("bucket", F.expr("upto - t").alias("before"))).alias("end"))
    ends = materialize(ends.select(*names, F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("before")), "ends")
    last = with_leaf(ordered, ends).where("bucket = end_bucket")
    # Rows without an id, or that repeat one, share a digest: they are summed before any are put in order.
    last = last.groupBy(*names, "digest").agg(F.sum("tokens_").alias("tokens_"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    run = F.sum("tokens_").over(Window.partitionBy(*names).orderBy("digest").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = last.withColumn("upto", F.col("before") + run).where("upto >= rest").groupBy(*names).agg(F.min("digest").alias("last_digest"))

    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    limits = quotas.alias("a").join(last.alias("b"), on, "left").select("a.*", "b.last_digest").drop("supply", "quota")
    limits = limits.withColumns({c: F.col(c) for c in names})
    renamed = limits.select(*names, F.col("full"), F.col("rest"), "last_digest")
    extra = {c: free_name([*given.columns, key], c) for c in ("full", "rest", "last_digest")}
    chosen = with_leaf(given, renamed.withColumnsRenamed(extra))
    position = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(extra["full"]).cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    partial = (F.col(extra["rest"]) > 0) & (position <= F.coalesce(F.col(extra["last_digest"]), F.lit("g")))
    times = F.col(extra["full"]) + F.when(partial, 1).otherwise(0)
    epochs = F.when(times > 0, F.sequence(F.lit(0).cast("bigint"), times - 1))
    return chosen.withColumn("epoch", F.explode(epochs)).drop(*extra.values())
