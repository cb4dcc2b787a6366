"""How far the sources of a language diverge in the terms they use.

The terms of a language that count are those in at least ``min_docs`` of its documents.  They are found by iceberg
prefix refinement: terms are followed by an end mark and cut to a byte prefix; documents are counted for each (language,
prefix) and prefixes below the threshold are discarded, since no term can be in more documents than its prefix; those
left are extended, level by level, until all of them are complete terms.  A level counts distinct
documents within a block of texts (a document is whole in one) and adds up the blocks' counts, so what is shuffled is a
row for each block and prefix that may still count, never a row for each word.

Distances between sources are taken in blocks of sources and buckets of terms, over the terms that one of them has; what
all the other terms add is the same for each and is multiplied out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, quoted, small_batches
from .words import Bitmap, bitmap, byte_kinds, chained, flat, hashes, split_words, text_blocks

#: Fixed value: a term is a run of ASCII letters and characters beyond ASCII.
TERM_BYTES = byte_kinds([b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)])
MIN_DOCS, TOP_TERMS, PRIOR, SCALE = 30, 50, 5, 1_000_000_000
#: Bytes of the prefixes of the first level; each further level doubles them.
FIRST_LEVEL = 4
#: Bytes of text that are counted at a time.
BLOCK_BYTES = 1 << 23
#: Sources of a block, term rows of a bucket, terms of a dense piece of it.
SOURCE_BLOCK, BUCKET_ROWS, PIECE_TERMS = 128, 50_000, 2048
_END = pa.scalar(b"\0", pa.large_binary())
_NONE = pa.scalar(b"", pa.large_binary())

Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _marked(vocabulary: pa.Array) -> pa.Array:
    """Terms with an end mark, which no term holds."""
    return pc.binary_join_element_wise(vocabulary, _END, _NONE)


def _key(prefix: pa.Array, lang: pa.Array) -> np.ndarray:
    return chained(hashes(prefix), hashes(lang))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[new], np.diff(np.append(new, len(keys)))


def _level(width: int, before: tuple[int, Bitmap] | None) -> Mapper:
    """Documents of each (language, prefix of ``width`` bytes) in a block, of terms whose shorter prefix may be left."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            words = split_words(block["text"], TERM_BYTES)
            langs = flat(block["lang"]).dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            terms = _marked(words.vocabulary)
            text, ids = words.text_of(), words.ids
            if before is not None:
                held, left = before
                longer = pc.binary_length(terms).to_numpy(zero_copy_only=False) > held
                go = longer[ids]
                text, ids = text[go], ids[go]
                go = left.may_hold(chained(hashes(pc.binary_slice(terms, 0, held))[ids], hashes(langs.dictionary)[code[text]]))
                text, ids = text[go], ids[go]
            if not len(ids):
                continue
            coded = pc.binary_slice(terms, 0, width).dictionary_encode()
            prefix, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            seen, _ = _distinct(text * n + prefix[ids])
            keys, docs = _distinct(code[seen // n] * n + seen % n)
            yield _batch(("lang", langs.dictionary.take(pa.array(keys // n))), ("prefix", coded.dictionary.take(pa.array(keys % n)).cast(pa.binary())), ("docs", pa.array(docs, pa.int64())))

    return count


def _batch(*columns: tuple[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c for _, c in columns], names=[n for n, _ in columns])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _batch(("h", pa.array(_key(b.column("prefix"), b.column("lang")).view(np.int64))))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term): the terms in at least ``min_docs`` rows of ``docs`` (lang, text) of their language."""
    width, before, out = FIRST_LEVEL, None, None
    done = F.substring("prefix", -1, 1) == F.lit(b"\0")
    while True:
        with small_batches(docs.sparkSession):
            counted = docs.select("lang", "text").mapInArrow(_level(width, before), "lang string, prefix binary, docs long")
            level = materialize(counted.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs), "prefixes")
        whole = level.where(done).select("lang", F.expr("cast(substring(prefix, 1, length(prefix) - 1) AS string)").alias("term"))
        out = whole if out is None else out.unionByName(whole)
        left = level.where(~done).select("lang", "prefix")
        n = left.count()
        if not n:
            return out
        before = width, bitmap(left.mapInArrow(_hashed, "h long"), "h", n)
        width *= 2


def _occurrences(left: Bitmap) -> Mapper:
    """How often each term that may be kept occurs in each (language, source) of a block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            words = split_words(block["text"], TERM_BYTES)
            langs, sources = (flat(block[c]).dictionary_encode() for c in ("lang", "source"))
            code, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources))
            text, ids = words.text_of(), words.ids
            go = left.may_hold(chained(hashes(words.vocabulary)[ids], hashes(langs.dictionary)[code[text]]))
            text, ids = text[go], ids[go].astype(np.int64)
            if not len(ids):
                continue
            n, m = len(words.vocabulary), len(sources.dictionary)
            keys, found = _distinct((code[text] * m + source[text]) * n + ids)
            group = keys // n
            yield _batch(
                ("lang", langs.dictionary.take(pa.array(group // m))), ("source", sources.dictionary.take(pa.array(group % m))),
                ("term", words.vocabulary.take(pa.array(keys % n)).cast(pa.string())), ("n", pa.array(found, pa.int64())),
            )

    return count


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, term, n): occurrences of the terms (lang, term) in each source that has them."""
    keys = terms.select("lang", F.col("term").cast("binary").alias("prefix"))
    left = bitmap(keys.mapInArrow(_hashed, "h long"), "h", terms.count())
    with small_batches(docs.sparkSession):
        found = docs.select("lang", "source", "text").mapInArrow(_occurrences(left), "lang string, source string, term string, n long")
        counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(terms, ["lang", "term"], "left_semi")
        return materialize(counts.select("lang", "source", "term", "n"), "term-counts")


def share(count: Column | str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly; null without terms."""
    count = F.col(count) if isinstance(count, str) else count
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(19,0)"), F.nullif(F.col(total) + PRIOR * F.col(terms), F.lit(0)).cast("decimal(19,0)")) + 1


def _pair_sums(source_block: int) -> Callable[[pa.Table], pa.Table]:
    """Sums of |p - q| over the terms of one bucket, for the pairs of sources of two blocks, and the number of terms.

    A row is a source, a term of it and its p; a row without a term has the p of all terms that a source lacks.
    """

    def sums(table: pa.Table) -> pa.Table:
        lang, i, j = (table.column(c)[0].as_py() for c in ("lang", "i", "j"))
        source, p = table["place"].to_numpy(), table["p"].to_numpy()
        coded = flat(table["term"]).dictionary_encode()
        term = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        sides = []
        for block in (i, j):
            own = np.flatnonzero((source >= block * source_block) & (source < (block + 1) * source_block))
            base = own[term[own] < 0]
            base = base[np.argsort(source[base])]
            rows = own[term[own] >= 0]
            rows = rows[np.argsort(term[rows], kind="stable")]
            sides.append((source[base], p[base], np.searchsorted(source[base], source[rows]), term[rows], p[rows]))
        total = np.zeros((len(sides[0][0]), len(sides[1][0])), np.int64)
        n_terms = len(coded.dictionary)
        for low in range(0, n_terms, PIECE_TERMS):
            high = min(n_terms, low + PIECE_TERMS)
            dense = []
            for _, base, at, t, value in sides:
                a, b = np.searchsorted(t, [low, high])
                m = np.repeat(base[:, None], high - low, axis=1)
                m[at[a:b], t[a:b] - low] = value[a:b]
                dense.append(m)
            for k, row in enumerate(dense[0]):
                total[k] += np.abs(dense[1] - row).sum(axis=1)
        a, b = (x.ravel() for x in np.meshgrid(sides[0][0], sides[1][0], indexing="ij"))
        once = a < b
        n = int(once.sum())
        return pa.table({"lang": pa.array([lang] * n, pa.string()), "a": pa.array(a[once], pa.int32()), "b": pa.array(b[once], pa.int32()), "s": total.ravel()[once], "t": np.full(n, n_terms, np.int64)})

    return sums


def _pairs(counts: DataFrame, stats: DataFrame, source_block: int) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language."""
    buckets = max(1, math.ceil(counts.count() / BUCKET_ROWS))
    own = F.floor(F.col("place") / source_block).cast("int")
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / source_block).cast("int")))
    # A source meets its whole language: a row goes to one group for each block of sources.
    terms = counts.join(stats, ["lang", "source"]).select("lang", "place", "sources", "term", share("n", "total", "terms").alias("p"), F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))
    rest = stats.select("lang", "place", "sources", F.lit(None).cast("string").alias("term"), F.coalesce("p0", F.lit(0).cast("bigint")).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    dealt = terms.unionByName(rest).select("lang", "place", "term", "p", "bucket", own.alias("own"), blocks.alias("other"))
    dealt = dealt.select("lang", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "bucket", "place", "term", "p")
    sums = dealt.groupBy("lang", "i", "j", "bucket").applyInArrow(_pair_sums(source_block), "lang string, a int, b int, s long, t long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    side = {k: stats.select("lang", F.col("place").alias(k), F.col("source").alias(f"source_{k}"), F.coalesce("p0", F.lit(0).cast("bigint")).alias(f"p_{k}"), *(["terms"] if k == "a" else [])) for k in "ab"}
    named = sums.join(side["a"], ["lang", "a"]).join(side["b"], ["lang", "b"])
    value = F.col("s") + (F.col("terms") - F.col("t")) * F.abs(F.col("p_a") - F.col("p_b"))
    both = F.inline(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    return named.withColumn("value", value).select("lang", "value", both).select("lang", "source", "item", "value")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", source_block: int = SOURCE_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and by which terms.

    Part ``pair``: ``item`` is another source of the language, ``value`` the sum of |p - q| over all kept terms.  Part ``term``: ``item`` is a
    kept term of the source with p above the language's q, ``value`` p - q, the ``top_terms`` largest.  p is ``share`` of the
    term's count.  Ranks go by value, then by the item's bytes.

    A null text, language or source is an empty one; a language of one source has no pairs, one without kept terms
    has pairs of value 0; each row of ``docs`` counts as a document, also where rows repeat; other columns are not
    looked at; an empty table gives no rows.
    """
    named = {"lang": lang_col, "source": source_col, "text": text_col}
    docs = docs.select(*[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(n) for n, c in named.items()])
    terms = materialize(kept_terms(docs, min_docs), "kept-terms")
    counts = term_counts(docs, terms)
    by_source, by_lang = counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), terms.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "terms"])
    sources = Window.partitionBy("lang")  # as many rows as the language has sources
    groups = groups.withColumns({"place": F.row_number().over(sources.orderBy("source")) - 1, "sources": F.count("*").over(sources), "p0": share(F.lit(0), "total", "terms")})
    stats = materialize(groups, "source-stats")
    pairs = _pairs(counts, stats, source_block)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair"))
    whole = stats.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    lang_counts = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    own = counts.join(stats.select("lang", "source", "total", "terms"), ["lang", "source"]).join(whole, "lang").join(lang_counts, ["lang", "term"])
    ahead = own.select("lang", "source", F.col("term").alias("item"), (share("n", "total", "terms") - share("lang_n", "lang_total", "terms")).alias("value")).where("value > 0")
    ahead = ahead.withColumn("rank", rank).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(ahead.select(columns))

