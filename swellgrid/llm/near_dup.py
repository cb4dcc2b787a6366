"""Near-duplicate documents: consistent weighted samples of TF-IDF shingles, banded and verified.

1. Document frequencies of five-word shingles go into a hashed table of 2^``SKETCH_BITS``
   slots (1 MB of weight levels when broadcast, at any corpus size), less the expected load of a
   slot.  Texts that share a shingle see the same weight, whatever falls into its slot besides.
2. Each text becomes a signature of consistent weighted samples.  Texts with the same
   shingle multiset collapse to one representative first.
3. Rows of the signature form overlapping bands.  In each bucket every member is paired with
   the bucket's leaders (two orders of the ids), which links most families at little cost.
   Members of a bucket that are then in different components are all compared with each
   other, in blocks of bounded size: a task gives back only links that join components.
4. Each pair is verified by the weighted Jaccard similarity of its shingles, read again from
   the texts that a bitmap of fixed size marks.  Components of the verified links are classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import arrays
from .common import discard, flag_members, free_name, materialize, quoted
from .components import connected_components
from .textvec import WeightedSampler, blocks, per_text, shingle_hashes, text_rows

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SAMPLES = 64
BAND_SAMPLES, BANDS = 6, 30
#: Members of a bucket that a task compares with as many others at a time, bytes of their features, and columns of its tables.
BLOCK_MEMBERS, BLOCK_BYTES, BLOCK_COLUMNS = 256, 1 << 22, 4096
SKETCH_BITS = 20
_CHUNKS = 64
_SEED = 11


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, texts_seen = np.zeros(1 << SKETCH_BITS, np.int64), 0
    for keys, texts in blocks(text_rows(batches)):
        texts_seen += len(keys)
        h, of = shingle_hashes(texts, SHINGLE_WORDS)
        once = np.concatenate([np.unique(x) for x in per_text(h, of, len(texts))]) if len(h) else h
        np.add.at(counts, (once >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
    if texts_seen:
        yield arrays.emit(counts, texts_seen, _CHUNKS)


def idf_levels(docs: DataFrame) -> np.ndarray:
    """Weight level (see ``WeightedSampler``) of each sketch slot: its smoothed IDF, normalised.

    The weight is 1 + ln(N / df) / ln N: 1 for a shingle that every text holds, 2 for one that a single text holds.
    Without the norm the few words that tell a text from its copies would outweigh all that a group shares
    once the group holds a large share of the corpus.
    """
    counts, texts = arrays.total(docs.mapInArrow(_count_shingles, arrays.SCHEMA), _CHUNKS)
    if counts is None:
        return np.zeros(1 << SKETCH_BITS, np.int8)
    n = max(2, texts)
    df = np.clip(counts - counts.sum() / len(counts), 1, n)
    return np.rint(WeightedSampler.STEPS * np.log2(1 + np.log(n / df) / np.log(n))).astype(np.int8)


def _levels(hashes: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Levels of the TF-IDF weights of 32-bit shingle hashes."""
    slot = (hashes >> np.uint64(32 - SKETCH_BITS)).astype(np.int64)
    return np.rint(WeightedSampler.STEPS * np.log2(tf)).astype(np.int64) + idf[slot]


def _signer(idf: Broadcast):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, levels = WeightedSampler(SAMPLES, _SEED), idf.value
        for keys, texts in blocks(text_rows(batches)):
            h, of = shingle_hashes(texts, SHINGLE_WORDS)
            same, sizes, signatures = [], [], []
            for own in per_text(h, of, len(texts)):
                sizes.append(len(own))
                if not len(own):
                    same.append(None)
                    signatures.append(None)
                    continue
                with np.errstate(over="ignore"):
                    same.append(f"{int(own.sum()):016x}{int((own * own).sum()):016x}{len(own)}")
                u, tf = _distinct(own >> np.uint64(32))
                signatures.append(sampler.signature(u, _levels(u, tf, levels)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(same, pa.string()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.list_(pa.int32()))],
                names=["id", "same", "shingles", "sig"],
            )

    return sign


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, sorted 32-bit shingle hashes with repeats)."""
    for keys, texts in blocks(text_rows(batches)):
        h, of = shingle_hashes(texts, SHINGLE_WORDS)
        packed = [np.sort((x >> np.uint64(32)).astype(np.uint32)).tobytes() for x in per_text(h, of, len(texts))]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=["id", "feats"])


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two (distinct sorted hashes, tf) shingle sets."""
    w = [2.0 ** (_levels(h, tf, idf) / WeightedSampler.STEPS) for h, tf in (a, b)]
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(w[0][i], w[1][j]).sum()
    return float(low / max(w[0].sum() + w[1].sum() - low, 1e-300))


def _verifier(idf: Broadcast, similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, last, own = idf.value, None, None

        def parsed(raw: bytes):
            return _distinct(np.frombuffer(raw, np.uint32).astype(np.uint64))

        for batch in batches:
            sims = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                if (raw := two.as_py()) != last:  # rows of one leader mostly follow each other
                    last, own = raw, parsed(raw)
                sims.append(weighted_jaccard(parsed(one.as_py()), own, levels))
            near = pa.array([x >= similarity for x in sims], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "similarity"]).filter(near)

    return verify


def _features(raw: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, weight) of each (shingle, n-th occurrence): the weights of common keys add up to the weighted intersection."""
    h = np.frombuffer(raw, np.uint32).astype(np.uint64)
    first = np.concatenate([[True], h[1:] != h[:-1]])
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
    upto = 2.0 ** (_levels(h, nth, idf) / WeightedSampler.STEPS)
    return (h << np.uint64(32)) | nth.astype(np.uint64), upto - np.where(first, 0, np.concatenate([[0.0], upto[:-1]]))


def similarities(feats: list[bytes], left: np.ndarray, right: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of the members at ``left`` with those at ``right``."""
    parts = [_features(raw, idf) for raw in feats]
    keys, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
    rows = np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts])
    totals = np.bincount(rows, weights, len(parts))
    _, columns, seen = np.unique(keys, return_inverse=True, return_counts=True)
    shared = seen > 1
    columns, rows, weights = (np.cumsum(shared) - 1)[columns[m := shared[columns]]], rows[m], weights[m]
    by_column = np.argsort(columns, kind="stable")
    columns, rows, weights = columns[by_column], rows[by_column], weights[by_column]
    low = np.zeros((len(left), len(right)))
    for c in range(0, int(shared.sum()), BLOCK_COLUMNS):
        i, j = np.searchsorted(columns, [c, c + BLOCK_COLUMNS])
        table = np.zeros((len(parts), BLOCK_COLUMNS))
        table[rows[i:j], columns[i:j] - c] = np.sqrt(weights[i:j])
        low += table[left] @ table[right].T
    return low / np.maximum(totals[left][:, None] + totals[right][None, :] - low, 1e-300)


def _joining(members: list[tuple], idf: np.ndarray, similarity: float) -> Iterator[tuple]:
    """(a, b, similarity, ca, cb) of links that join components of a block's members (id, component, salt, feats): a forest, never all pairs."""
    members = sorted(members, key=lambda m: m[0])
    feats = [m[3] for m in members]
    salts = np.array([m[2] for m in members])
    left = np.flatnonzero(salts == salts.min())
    right = np.flatnonzero(salts == salts.max())
    sims = similarities(feats, left, right, idf)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    # What rounding may move over the limit is decided by the plain formula.
    component = np.array([m[1] for m in members])
    for i, j in np.argwhere((sims >= similarity - 1e-9) & (component[left][:, None] != component[right])):
        a, b = left[i], right[j]
        one, two = find(members[a][1]), find(members[b][1])
        if one == two:
            continue
        sim = float(sims[i, j])
        if abs(sim - similarity) <= 1e-9:
            sim = weighted_jaccard(*[_distinct(np.frombuffer(feats[k], np.uint32).astype(np.uint64)) for k in (a, b)], idf)
        if sim >= similarity:
            root[max(one, two)] = min(one, two)
            yield members[a][0], members[b][0], sim, members[a][1], members[b][1]


def _block_matcher(idf: Broadcast, similarity: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(members: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if (found := list(_joining(members, idf.value, similarity))) else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "similarity", "ca", "cb"])

        block, members = None, []
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                key = tuple(x.as_py() for x in row[:3])
                if key != block:
                    if members:
                        yield done(members)
                    block, members = key, []
                members.append(tuple(x.as_py() for x in row[3:]))
        if members:
            yield done(members)

    return match


def _buckets(reps: DataFrame) -> DataFrame:
    """(id, bucket): the bucket is a hash of the band and its samples."""
    rng = np.random.default_rng(1000)
    bands = [np.sort(rng.choice(SAMPLES, BAND_SAMPLES, replace=False)) for _ in range(BANDS)]
    keys = [F.xxhash64(F.lit(k), *[F.get("sig", F.lit(int(i))) for i in band]) for k, band in enumerate(bands)]
    return reps.select("id", F.explode(F.array(*keys)).alias("bucket"))


def _feats(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, feats, size) of the ids ``wanted``, read again from the texts that their bitmap marks."""
    marked = flag_members(docs, F.col("id"), wanted, F.col("id"), "flag").where("flag")
    packed = marked.select("id", "text").mapInArrow(_packed, "id long, feats binary").join(wanted, "id", "left_semi")
    return materialize(packed.withColumn("size", F.length("feats")), "feats")


def _block_links(shared: DataFrame, component: DataFrame, feats: DataFrame, idf: Broadcast, similarity: float) -> DataFrame:
    """(a, b, similarity, ca, cb): links between the members of each bucket that are still in different components ca and cb.

    The leaders have met every member of their bucket.  All others meet, whether a leader matched
    them or not; a bucket of more than ``BLOCK_MEMBERS``, or of more than ``BLOCK_BYTES`` of features, is
    dealt in salted blocks, at most one for each member.
    """
    sizes = feats.groupBy("id").agg(F.sum("size").alias("size"))
    rest = shared.where("id <> l1 AND id <> l2").join(component, "id", "left").join(sizes, "id")
    rest = materialize(rest.select("id", "bucket", F.coalesce("component", "id").alias("component"), "size"), "unsettled")
    stats = [F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("component").alias("lo"), F.max("component").alias("hi")]
    open_ = rest.groupBy("bucket").agg(*stats).where("lo <> hi")
    salts = F.least("n", F.ceil(F.greatest(F.col("n") / BLOCK_MEMBERS, F.col("bytes") / BLOCK_BYTES))).cast("int")
    open_ = materialize(open_.select("bucket", salts.alias("salts")), "open")
    rest_open = rest.drop("size").join(open_, "bucket").withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int"))
    others = rest_open.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    others = materialize(others.select("bucket", F.least("salt", "other").alias("x"), F.greatest("salt", "other").alias("y"), "id", "component", "salt"), "members")
    dealt = others.join(feats, "id").select("bucket", "x", "y", "id", "component", "salt", "feats")
    dealt = dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    found = materialize(dealt.mapInArrow(_block_matcher(idf, similarity), "a long, b long, similarity double, ca long, cb long"), "block-links")
    discard(rest, open_, others)
    return found


def near_components(docs: DataFrame, signed: DataFrame, idf: Broadcast, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, similarity) between ``signed`` representatives (id, sig), and their components (id, component).

    The links connect all pairs of at least ``similarity`` that share a bucket.
    """
    order = F.xxhash64("id")
    leaders = _buckets(signed).groupBy("bucket").agg(F.min("id").alias("l1"), F.min_by("id", order).alias("l2"), F.count("*").alias("n")).where("n > 1").drop("n")
    leaders = materialize(leaders, "leaders")
    shared = materialize(_buckets(signed).join(leaders, "bucket"), "shared")
    pairs = materialize(shared.select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array("l1", "l2"))).alias("b")).where("a <> b").distinct(), "pairs")
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    feats = _feats(docs, wanted)
    sims = (
        pairs.join(feats.select(F.col("id").alias("a"), F.col("feats").alias("fa")), "a")
        .join(feats.select(F.col("id").alias("b"), F.col("feats").alias("fb")), "b")
        .select("a", "b", "fa", "fb")
        .mapInArrow(_verifier(idf, similarity), "a long, b long, similarity double")
    )
    links = materialize(sims, "similarities")
    discard(leaders, pairs, wanted)
    component = connected_components(links.select("a", "b"))
    found = _block_links(shared, component, feats, idf, similarity)
    discard(shared, feats)
    if found.head(1):  # what the blocks add joins components
        joined = materialize(connected_components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "joined")
        higher = joined.select(F.col("id").alias("component"), F.col("component").alias("root"))
        component = component.join(higher, "component", "left").select("id", F.coalesce("root", "component").alias("component")).unionByName(joined).distinct()
    return links.unionByName(found.select("a", "b", "similarity")), component


def near_dup_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (smallest id of its class), ``class_size``, ``kept``.

    Documents are linked at a weighted Jaccard similarity of ``similarity`` or more over
    the TF-IDF weighted five-word shingles of their lower-case words; a class is what links
    connect.  A text of fewer than five words has one shingle of all its words.  Null,
    empty and wordless texts are linked with nothing.  Rows that repeat an id count as one
    document and give one row; rows with a null id give none.  Ids of
    another type than an integer raise ``TypeError``.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} has to be an integer column")
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    idf = spark.sparkContext.broadcast(idf_levels(docs))
    signed = materialize(docs.mapInArrow(_signer(idf), "id long, same string, shingles int, sig array<int>"), "signatures")
    heads = signed.where("same IS NOT NULL").groupBy("same").agg(F.min(F.struct("id", "sig")).alias("head"))
    heads = materialize(heads.select("head.id", "head.sig").groupBy("id").agg(F.min("sig").alias("sig")), "heads")
    _, component = near_components(docs, heads, idf, similarity)
    idf.destroy()
    same = signed.where("same IS NOT NULL").groupBy("same").agg(F.min("id").alias("rep"))
    rep_class = same.join(component.withColumnRenamed("id", "rep"), "rep", "left").select("same", F.coalesce("component", "rep").alias("class_id"))
    rep_class = materialize(rep_class, "classes")
    ids = signed.select("id", "same").join(rep_class, "same", "left")
    out = materialize(ids.groupBy("id").agg(F.coalesce(F.min("class_id"), F.col("id")).alias("class_id")), "near-dups")
    sizes = out.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return out.join(materialize(sizes, "sizes"), "class_id").select(
        F.col("id").alias(id_col), "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept")
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without the near duplicates of another: of each class the smallest id stays.

    Rows with a null id stay.  Only rows that the bitmap of dropped ids marks are shuffled.
    """
    classes = near_dup_classes(docs, id_col, text_col, similarity)
    dropped = materialize(classes.where("NOT kept").select(F.col(id_col).cast("bigint").alias("dropped_")), "dropped")
    flag = free_name(docs.columns, "flag_")
    key = F.col(quoted(id_col)).cast("bigint")
    flagged = flag_members(docs, key, dropped, F.col("dropped_"), flag)
    maybe = flagged.where(F.col(flag) & key.isNotNull()).join(dropped, key == F.col("dropped_"), "left_anti")
    columns = [quoted(c) for c in docs.columns]
    return flagged.where(~F.col(flag) | key.isNull()).select(*columns).unionByName(maybe.select(*columns))
