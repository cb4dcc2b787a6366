"""URL filter: host and path rules, and a character language-model ratio where no rule fits.

URLs that the rules allow and block train two smoothed variable-order Markov models of
characters (Witten-Bell interpolation of orders 0 to ``ORDER``).  The difference of the
length-normalised log-likelihoods, cut at a threshold calibrated on labelled URLs that
the models haven't seen, judges the rest.  Everything is joins and sums over n-grams, whose
rows carry the number of a URL, not the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize

ORDER = 4
#: Up to so many distinct n-grams (some 10 MB) the model is broadcast; beyond it is joined by a shuffle.
BROADCAST_GRAMS = 150_000
ALPHABET = 128
_PAD = "\x02" * ORDER
_BINS = 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-case host (after the first ``://`` up to ``/``, ``?`` or ``#``) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def learns(u: Column) -> Column:
    """Whether a URL is in the half that trains the models; the other half calibrates the threshold."""
    return F.substring(F.md5(u.cast("binary")), 1, 1) < "8"


def _grams(urls: DataFrame) -> DataFrame:
    """(columns but u, g): each character of a URL with the ``ORDER`` before it; ``u`` is the lower-case URL."""
    padded = F.concat(F.lit(_PAD), F.col("u"))
    places = F.sequence(F.lit(1), F.length("u"))
    grams = F.when(F.length("u") > 0, F.transform(places, lambda i: F.substring(padded, i, ORDER + 1)))
    return urls.withColumn("g", grams).drop("u").withColumn("g", F.explode("g"))


def gram_ratios(grams: DataFrame) -> DataFrame:
    """(g, na, nr) counts in accepted and rejected training URLs -> (g, ratio): log P_accepted - log P_rejected."""
    out = grams
    prob = {"a": F.lit(1.0 / ALPHABET), "r": F.lit(1.0 / ALPHABET)}
    for k in range(ORDER + 1):
        suffix = F.substring("g", ORDER + 1 - k, k + 1)
        counts = grams.groupBy(suffix.alias("s")).agg(F.sum("na").alias("ca"), F.sum("nr").alias("cr"))
        counts = counts.withColumn("h", F.substring("s", 1, k)) if k else counts.withColumn("h", F.lit(""))
        context = counts.groupBy("h").agg(
            F.sum("ca").alias("ha"), F.sum("cr").alias("hr"),
            F.sum((F.col("ca") > 0).cast("long")).alias("ta"), F.sum((F.col("cr") > 0).cast("long")).alias("tr"),
        )
        level = materialize(counts.join(context, "h"), "url-model")
        out = out.withColumn("s", suffix).join(level, "s")
        for m in "ar":
            n, h, t = F.col(f"c{m}"), F.col(f"h{m}"), F.col(f"t{m}")
            prob[m] = F.when(h > 0, (n + t * prob[m]) / (h + t)).otherwise(prob[m])
        out = out.select("g", "na", "nr", prob["a"].alias("pa"), prob["r"].alias("pr"))
        prob = {"a": F.col("pa"), "r": F.col("pr")}
    return out.select("g", (F.log("pa") - F.log("pr")).alias("ratio"))


def calibrated_threshold(scored: DataFrame) -> float:
    """Threshold of ``score`` with the most (allowed kept - blocked kept), from ``_BINS`` counts; -inf without both kinds."""
    lo, hi, kinds = scored.agg(F.min("score"), F.max("score"), F.count_distinct("verdict")).first()
    if kinds < 2 or lo is None or lo == hi:
        return float("-inf")
    slot = F.least(F.floor((F.col("score") - F.lit(lo)) / F.lit((hi - lo) / _BINS)), F.lit(_BINS - 1)).cast("int")
    counts = scored.groupBy(slot.alias("s")).agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("a"), F.sum((F.col("verdict") == "block").cast("long")).alias("b")).collect()
    total_a, total_b = sum(r["a"] for r in counts), sum(r["b"] for r in counts)
    best, cut, above_a, above_b = 0.0, lo, 0, 0
    for r in sorted(counts, key=lambda r: -r["s"]):
        above_a, above_b = above_a + r["a"], above_b + r["b"]
        gain = above_a / total_a - above_b / total_b
        if gain >= best:
            best, cut = gain, lo + r["s"] * (hi - lo) / _BINS
    return cut


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """All rows and columns of ``pages`` plus ``host``, ``path``, ``rule``, ``score`` and ``verdict``.

    ``rule`` is null where none fits; ``score`` is the length-normalised log-likelihood
    difference of the lower-case URL, 0 for null and empty ones.  Equal URLs are scored
    once.  With no URL allowed, or none blocked, by rules all others are allowed.  An empty
    table gives no rows.  Columns of ``pages`` with those names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "score", "verdict")
    u = free_name(pages.columns, "u")
    spelt = F.translate(F.coalesce(F.col(url_col), F.lit("")), _UPPER, _LOWER)
    host, path = url_parts(F.col(url_col))
    base = pages.withColumn(u, spelt).withColumn("host", host).withColumn("path", path)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("verdict_", verdict)

    # A URL can be spelt in ways that rules tell apart only by the case of its path; it trains by its first.
    urls = base.groupBy(F.col(u).alias("u")).agg(F.min("verdict_").alias("verdict"))
    urls = urls.withColumn("train", learns(F.col("u"))).withColumn("n", F.monotonically_increasing_id())
    urls = materialize(urls, "urls")  # written once, and so are their numbers
    grams = _grams(urls)
    learn = F.col("train")
    counts = grams.groupBy("g").agg(
        F.sum((learn & (F.col("verdict") == "allow")).cast("long")).alias("na"),
        F.sum((learn & (F.col("verdict") == "block")).cast("long")).alias("nr"),
    )
    counts = counts.select("g", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nr", F.lit(0)).alias("nr"))
    ratios = materialize(gram_ratios(materialize(counts, "grams")), "ratios")
    if ratios.count() <= BROADCAST_GRAMS:
        ratios = F.broadcast(ratios)
    scores = grams.select("n", "g").join(ratios, "g").groupBy("n").agg(F.avg("ratio").alias("score"))
    scores = materialize(urls.join(scores, "n", "left").select("u", "train", "verdict", F.coalesce("score", F.lit(0.0)).alias("score")), "scores")
    cut = calibrated_threshold(scores.where("NOT train AND verdict IS NOT NULL AND u <> ''"))
    out = base.join(scores.select(F.col("u").alias(u), "score"), u, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    own = F.when(F.col("score") >= F.lit(cut), F.lit("allow")).otherwise(F.lit("block"))
    return out.withColumn("verdict", F.coalesce("verdict_", own)).drop(u, "verdict_")
