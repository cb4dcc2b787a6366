"""Quality selection by importance resampling over hashed n-grams.

Two bag-of-n-grams models, one of the target text (a bounded sample of documents that are
labelled good) and one of all raw text, give each document the log of its importance weight: the
sum of its n-grams' log ratios.  The target model is smoothed towards the raw one, as strongly as
makes good texts that it hasn't seen most likely, so that what few labels can't tell counts for nothing
and the errors of the model don't add up over long texts.
The number k of documents to keep comes from a cut that the labelled sample calibrates,
and the k largest log-weights perturbed by seeded Gumbel noise are selected, which samples
without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import free_name, kth_largest, materialize
from .textvec import blocks, mix, text_rows, token_hashes

#: Buckets of the hashed n-grams (a power of two).
BUCKETS = 1 << 14
#: Most labelled rows the target model and the calibration are fitted on.
LABELLED_ROWS = 20_000
SEED = 17
#: How much of its gain the cut may forgo to keep more.
CUT_TOLERANCE = 0.01
_SMOOTH = 1.0
#: Strengths of the target model's smoothing that are tried.
PSEUDO_COUNTS = tuple(2.0**k for k in range(-2, 13))
_NEXT, _HERE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token and each pair of neighbours, and its text; a token that repeats the last is one shared pair."""
    h, of = token_hashes(texts)
    if not len(h):
        return np.empty(0, np.int64), of
    same = of[1:] == of[:-1]
    pair = np.where(h[1:] == h[:-1], np.uint64(1), mix(h[1:] * _NEXT + h[:-1] * _HERE))[same]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return (mix(np.concatenate([h, pair])) >> shift).astype(np.int64), np.concatenate([of, of[1:][same]])


def _counter(sample):
    """Counts of all n-grams and of those of two sets of texts (fitted, held out)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, counts, rows = sample.value, np.zeros((4, BUCKETS), np.int64), 0
        for keys, texts in blocks(text_rows(batches), lower=False):
            rows += len(keys)
            f, of = _ngrams(texts)
            counts[0] += np.bincount(f, minlength=BUCKETS)
            set_of = np.fromiter((group.get(k, 0) for k in keys), np.int64, len(keys))
            for g in (1, 2):
                counts[g] += np.bincount(f[set_of[of] == g], minlength=BUCKETS)
        if rows:
            yield arrays.emit(counts.ravel(), rows, 4)

    return count


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, rows: int = LABELLED_ROWS) -> dict[int, int]:
    """At most ``rows`` labelled ids with their label, the same whatever the order of rows."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    got = known.orderBy(F.xxhash64(F.lit(SEED), id_col), id_col).limit(rows).collect()
    return {r[0]: int(r["y"]) for r in got}


def smoothed_log_ratio(raw: np.ndarray, good: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket from counts of raw, target and held-out target n-grams.

    A bucket's target count is held against the count it would have under the raw model, with a pseudo-count on
    both sides that draws the ratio to 1 where little is expected.  Of ``PSEUDO_COUNTS`` the one that makes the held-out
    n-grams most likely is taken (without any, the middle one).
    """
    p_raw = (raw + _SMOOTH) / (raw + _SMOOTH).sum()
    expected = good.sum() * p_raw
    best = None
    for m in PSEUDO_COUNTS if unseen.sum() else PSEUDO_COUNTS[len(PSEUDO_COUNTS) // 2 :][:1]:
        ratio = (good + m) / (expected + m)
        log_ratio = np.log(ratio / (p_raw * ratio).sum())
        fit = float((unseen * log_ratio).sum())
        if best is None or fit > best[0]:
            best = fit, log_ratio
    return best[1]


def fit_log_ratio(docs: DataFrame, sample: dict[int, int], id_col: str, text_col: str) -> np.ndarray:
    """log p_target - log p_raw of each bucket; zero if there is no target text.

    ``sample`` has the good texts' ids: 1 those that the target model is fitted on, 2 those that its smoothing is.
    """
    group = docs.sparkSession.sparkContext.broadcast(sample)
    counts, _ = arrays.total(docs.select(id_col, text_col).mapInArrow(_counter(group), arrays.SCHEMA), 4)
    group.destroy()
    if counts is None or not counts[BUCKETS : 2 * BUCKETS].any():
        return np.zeros(BUCKETS)
    raw, good, unseen, _ = counts.reshape(4, BUCKETS)
    return smoothed_log_ratio(raw, good, unseen)


def log_weight(text: Column, ratio) -> Column:
    """Log importance weight: the sum of a text's n-gram log ratios; 0 for null or empty text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        table, out = ratio.value, []
        for keys, block in blocks(((0, t.as_py()) for t in texts), lower=False):
            f, of = _ngrams(block)
            out.append(np.bincount(of, weights=table[f], minlength=len(keys)))
        return pa.array(np.concatenate(out) if out else np.empty(0))

    return score(text)


def gumbel(*key: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on the key alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def calibrated_cut(scored: list[tuple[float, int]]) -> float | None:
    """Cut with the most (good kept - bad kept), as shares; of cuts within ``CUT_TOLERANCE`` of it the middle of the lowest gap."""
    good = np.sort([s for s, y in scored if y == 1])
    bad = np.sort([s for s, y in scored if y == 0])
    if not len(good) or not len(bad):
        return None
    at = np.unique(np.concatenate([good, bad]))
    kept_good = 1 - np.searchsorted(good, at, side="left") / len(good)
    kept_bad = 1 - np.searchsorted(bad, at, side="left") / len(bad)
    gain = kept_good - kept_bad
    i = int(np.argmax(gain >= gain.max() - CUT_TOLERANCE))
    return float(at[i] if i == 0 else (at[i] + at[i - 1]) / 2)


def quality_selection(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    keep: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """All rows and columns of ``docs`` plus ``log_weight``, ``sample_key`` and ``selected``.

    ``keep`` is the number of rows to select; by default as many as have a log-weight at
    the calibrated cut or above.  Rows that tie at the last place are all selected.  Null
    text is empty and has log-weight 0.  Without labels of both kinds all rows are selected.
    An empty table gives no rows.  Columns of ``docs`` with those names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("log_weight", "sample_key", "selected")
    sample = labelled_sample(labels, id_col, label_col)
    # Half of the sample fits the target model, a quarter its smoothing, and the cut is calibrated on the quarter neither has seen.
    use = {k: (1, 2, 1, 3)[i % 4] for i, k in enumerate(sample)}
    good = {k: use[k] for k, y in sample.items() if y == 1 and use[k] < 3}
    ratio = spark.sparkContext.broadcast(fit_log_ratio(docs, good, id_col, text_col))
    key = free_name(docs.columns, "key_")
    scored = docs.withColumn("log_weight", log_weight(F.col(text_col), ratio))
    scored = scored.withColumn("sample_key", F.col("log_weight") + gumbel(F.col(id_col), F.col(text_col), seed=seed))
    light = materialize(scored.select(F.col(id_col).alias(key), "log_weight", "sample_key"), "log-weights")
    if keep is None:
        ids = spark.createDataFrame([(k, y) for k, y in sample.items() if use[k] == 3], f"{key} long, y int")  # at most LABELLED_ROWS rows
        known = light.join(F.broadcast(ids), key).groupBy(key).agg(F.max("log_weight").alias("s"), F.max("y").alias("y"))
        cut = calibrated_cut([(r["s"], r["y"]) for r in known.select("s", "y").collect()])
        keep = light.where(F.col("log_weight") >= cut).count() if cut is not None else None
    last = kth_largest(light, "sample_key", keep) if keep is not None else float("-inf")
    return scored.withColumn("selected", F.col("sample_key") >= F.lit(float("inf") if last is None else last))
