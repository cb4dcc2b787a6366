"""Collocations of each language: phrases that occur more often than their parts would make them.

Counts of n-grams are weighted acyclic automata (``automaton``).  A block of texts builds one from its sorted n-grams, cut at
the bounds of prefix ranges; the automata of a range are united, weights summed, and n-grams below the least count go.  Lengths
follow one another: an n-gram can only be frequent if the two that are one word shorter are, so a bitmap of these
keeps most others out of the automata, and never drops a frequent one.  The counts of a phrase's parts, which lie in
other ranges, are looked up by composing the parts asked of a range with its automaton.

Ranges are bounds on (language, first word, second word) that deal out the words evenly; a first word that fills several ranges
is cut by its second word, so no range grows with one frequent word.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .automaton import build, common_labels, counted, lookup, pack, paths, relabelled, summed, unpack
from .common import materialize, quoted, small_batches
from .words import Bitmap, bitmap, byte_kinds, chained, flat, hashes, split_words, text_blocks

#: Fixed value: blanks part words, stops part pieces too.
PIECE_BYTES = byte_kinds(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
MIN_COUNT, MAX_WORDS, TOP, SCALE, ABSORBED = 10, 3, 2000, 1_000_000, 50
#: Bytes of text of which automata are built.
BLOCK_BYTES = 1 << 23
#: Words of a prefix range, and the most ranges; automata that are read at a time; n-grams that are held before they are summed.
RANGE_WORDS, MAX_RANGES, AUTOMATA_ROWS, HELD_GRAMS = 1 << 20, 1 << 16, 64, 1 << 21
#: Parts of a language's phrases that are ranked on their own first.
RANK_PARTS = 256
_AUTOMATA = "range int, lang string, automaton binary"

Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
Bounds = list[tuple[bytes, ...]]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a block, and (lang, null, n) for all its words."""
    for block in text_blocks(batches, limit=BLOCK_BYTES):
        words = split_words(block["text"], PIECE_BYTES)
        langs = flat(block["lang"]).dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.text_of()]
        if not len(code):
            continue
        (lang, word), n = counted([code, words.ids])
        total = np.bincount(code, minlength=len(langs.dictionary))
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), words.vocabulary.take(pa.array(word)).cast(pa.string()), pa.array(n)], names=["lang", "word", "n"])
        yield pa.RecordBatch.from_arrays([langs.dictionary, pa.nulls(len(total), pa.string()), pa.array(total)], names=["lang", "word", "n"])


def range_bounds(words: DataFrame, total: int, range_words: int = RANGE_WORDS) -> Bounds:
    """Sorted prefixes (language, word[, word]) that part the n-grams into ranges of about equal counts.

    From a systematic sample of about four words a range, in proportion to their counts ``n``.  It decides about
    the balance of ranges only.
    """
    ranges = min(MAX_RANGES, math.ceil(total / range_words))
    if ranges < 2:
        return []
    chance = F.col("n") * F.lit(4.0 * ranges / total) + F.pmod(F.xxhash64("lang", "word"), F.lit(1 << 20)) / float(1 << 20)
    drawn = [(r["lang"].encode(), r["word"].encode(), r["k"]) for r in words.select("lang", "word", F.floor(chance).alias("k")).where("k > 0").collect()]
    drawn.sort()
    step, place, bounds = sum(k for *_, k in drawn) / ranges, 0, []
    of_lang: dict[bytes, list[bytes]] = {}
    for lang, word, k in drawn:
        of_lang.setdefault(lang, []).extend([word] * k)
    for lang, word, k in drawn:
        inside = [j for j in range(math.ceil(place / step), math.ceil((place + k) / step)) if j]
        bounds += [(lang, word) if i == 0 else (lang, word, _other(of_lang[lang], word, i / len(inside))) for i in range(len(inside))]
        place += k
    return sorted(set(bounds))


def _other(words: list[bytes], word: bytes, share: float) -> bytes:
    """The word that ``share`` of the sorted ``words`` other than ``word``, which seldom follows itself, are below."""
    low, high = bisect_left(words, word), bisect_right(words, word)
    i = int(share * (len(words) - high + low))
    i += high - low if i >= low else 0
    return words[min(i, len(words) - 1)]


def _gram_builder(size: int, shorter: Bitmap, bounds: Bounds) -> Mapper:
    """Automata of the n-grams of ``size`` words (and of single words, at two) of each block, language and range."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            words = split_words(block["text"], PIECE_BYTES)
            langs = flat(block["lang"]).dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.text_of()]
            ids = words.ids
            own = hashes(words.vocabulary)[ids]
            h = chained(hashes(langs.dictionary)[code], own)
            for k in range(1, size - 1):
                h = chained(h[:-1], own[k:])
            n = len(ids) - size + 1
            if n <= 0 and size > 2:
                continue
            may = shorter.may_hold(h)
            n = max(n, 0)
            at = np.flatnonzero(may[:n] & may[1 : n + 1] & (words.piece[:n] == words.piece[size - 1 : size - 1 + n]))
            columns, counts = counted([code[at], *(ids[at + k] for k in range(size))])
            if size == 2:
                one, n_one = counted([code[may], ids[may]])
                columns = [np.concatenate(c) for c in zip(columns, [*one, np.full(len(n_one), -1, np.int64)], strict=True)]
                counts = np.concatenate([counts, n_one])
            if not len(counts):
                continue
            named, vocabulary = relabelled(columns[1:], words.vocabulary)
            (lang, *named), counts = summed([columns[0], *named], counts)
            text = vocabulary.to_pylist()
            edges = np.searchsorted(lang, np.arange(len(langs.dictionary) + 1)).tolist()
            for k, name in enumerate(langs.dictionary.to_pylist()):
                yield from _in_ranges(name, named, counts, text, vocabulary, edges[k], edges[k + 1], bounds)

    return grams


def _in_ranges(lang: str, columns: list[np.ndarray], counts: np.ndarray, text: list[bytes], vocabulary: pa.Array, low: int, high: int, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """An automaton for each range that rows ``low`` to ``high``, which are sorted, reach into."""
    key = lang.encode()

    def prefix(i: int) -> tuple[bytes, ...]:
        return (key, *(text[c[i]] for c in columns if c[i] >= 0))

    range_, last = bisect_right(bounds, (key,)), bisect_right(bounds, (key, b"\xff"))
    while low < high:
        cut = bisect_left(range(high), bounds[range_], low, high, key=prefix) if range_ < last else high
        if cut > low:
            part, words = relabelled([c[low:cut] for c in columns], vocabulary, by_bytes=False)
            data = pack(build(part, counts[low:cut]), words)
            yield pa.RecordBatch.from_arrays([pa.array([range_], pa.int32()), pa.array([lang]), pa.array([data], pa.binary())], names=["range", "lang", "automaton"])
        low, range_ = cut, range_ + 1


def _uniter(least: int) -> Mapper:
    """The union of the automata of each range and language, which come together, without n-grams below ``least``."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, size = None, [], 0
        for b in batches:
            for range_, lang, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != (range_, lang):
                    yield from _united(group, held, least)
                    group, held, size = (range_, lang), [], 0
                levels, words = unpack(data)
                held.append((*paths(levels), words))
                size += len(held[-1][1])
                if size > HELD_GRAMS and len(held) > 1:
                    columns, counts, words = common_labels(held)
                    held = [(*summed(columns, counts), words)]
                    size = max(0, len(held[0][1]) - HELD_GRAMS // 2)
        yield from _united(group, held, least)

    return unite


def _united(group: tuple[int, str] | None, held: list, least: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    columns, counts, words = common_labels(held)
    columns, counts = summed(columns, counts)
    columns, counts = [c[counts >= least] for c in columns], counts[counts >= least]
    if len(counts):
        columns, words = relabelled(columns, words, by_bytes=False)
        data = pack(build(columns, counts), words)
        yield pa.RecordBatch.from_arrays([pa.array([group[0]], pa.int32()), pa.array([group[1]]), pa.array([data], pa.binary())], names=["range", "lang", "automaton"])


def _gram_rows(size: int) -> Mapper:
    """(lang, phrase, words, a, h) of the n-grams of ``size`` words in automata."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, lang, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                levels, words = unpack(data)
                columns, counts = paths(levels)
                whole = columns[size - 1] >= 0
                columns, counts = [c[whole] for c in columns[:size]], counts[whole]
                h, own = hashes(pa.array([lang.encode()], pa.large_binary())), hashes(words)
                h = np.repeat(h, len(counts))
                for c in columns:
                    h = chained(h, own[c])
                text = words.cast(pa.string())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * size, pa.int32()), text.take(pa.array(np.stack(columns, axis=1).ravel())))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), listed, pa.array(counts), pa.array(h.view(np.int64))], names=["lang", "words", "a", "h"])

    return rows


_GRAMS = "lang string, words array<string>, a long, h long"


def gram_automata(docs: DataFrame, least: int = MIN_COUNT, max_words: int = MAX_WORDS, range_words: int = RANGE_WORDS) -> tuple[DataFrame, list[DataFrame], Bounds]:
    """Of ``docs`` (lang, text): (lang, n) with all words of each language, the automata of the n-grams of 2 to ``max_words``
    words that occur ``least`` times (single words with the pairs), a table (range, lang, automaton) for each length, and the bounds of the ranges."""
    spark = docs.sparkSession
    counted = docs.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialize(counted.where((F.col("n") >= least) | F.col("word").isNull()), "words")
    totals, words = counted.where("word IS NULL").select("lang", "n"), counted.where("word IS NOT NULL")
    bounds = range_bounds(words, totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], range_words)
    shorter = bitmap(words.mapInArrow(_word_hashes, "h long"), "h", words.count())
    tables = []
    for size in range(2, max_words + 1):
        with small_batches(spark):
            built = materialize(docs.mapInArrow(_gram_builder(size, shorter, bounds), _AUTOMATA), "shard-automata")
        with small_batches(spark, AUTOMATA_ROWS):
            united = built.repartition("range").sortWithinPartitions("range", "lang").mapInArrow(_uniter(least), _AUTOMATA)
            tables.append(materialize(united, "automata"))
            if size < max_words:
                keys = tables[-1].mapInArrow(_gram_rows(size), _GRAMS)
                shorter = bitmap(keys, "h", keys.count())
    return totals, tables, bounds


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(chained(hashes(b.column("lang")), hashes(b.column("word"))).view(np.int64))], names=["h"])


def _range_finder(bounds: Bounds) -> Mapper:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bisect_right(bounds, (lang.encode(), *part.encode().split(b" "))) for lang, part in zip(b.column("lang").to_pylist(), b.column("part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), b.column("lang"), b.column("part")], names=["range", "lang", "part"])

    return place


def _composed(automata: pa.Table, parts: pa.Table) -> pa.Table:
    """Counts of the parts asked of a range by composition with its automata, one for each length."""
    asked = [p.encode().split(b" ") for p in parts["part"].to_pylist()]
    count = np.zeros(len(asked), np.int64)
    size = max(map(len, asked), default=0)
    coded = pa.array([w for p in asked for w in p], pa.large_binary())
    for data in automata["automaton"].to_pylist():
        levels, words = unpack(data)
        label = pa.compute.fill_null(pa.compute.index_in(coded, words), len(words)).to_numpy(zero_copy_only=False).astype(np.int64)
        columns = np.full((len(asked), max(size, len(levels))), -1, np.int64)
        columns[np.arange(columns.shape[1]) < np.array([len(p) for p in asked])[:, None]] = label
        fits = (columns[:, len(levels) :] < 0).all(axis=1)
        count[fits] = np.maximum(count[fits], lookup(levels, list(columns[fits, : len(levels)].T)))
    return pa.table({"lang": parts["lang"], "part": parts["part"], "f": count})


def part_counts(parts: DataFrame, automata: Sequence[DataFrame], bounds: Bounds) -> DataFrame:
    """(lang, part, f): the counts of phrases (lang, part; words joined by blanks) by the automata of their ranges."""
    asked = parts.select("lang", "part").distinct().mapInArrow(_range_finder(bounds), "range int, lang string, part string")
    tables = automata[0]
    for t in automata[1:]:
        tables = tables.unionByName(t)
    return tables.groupBy("range", "lang").cogroup(asked.groupBy("range", "lang")).applyInArrow(_composed, "lang string, part string, f long")


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def find_collocations(
    docs: DataFrame, least: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, absorbed: int = ABSORBED, lang_col: str = "lang", text_col: str = "text", range_words: int = RANGE_WORDS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``max_words`` words of each language.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its parts at the cut of the lowest score (the first of several),
    ``score`` floor(SCALE * a * a / (l * r)), ``n`` all words of the language.  A phrase that ``absorbed`` percent of its
    occurrences or more have within one longer candidate is left out.

    A null text is empty, a null language ``und``; counts are sums over rows, repeated or not; ties go by count, then by the
    phrase's bytes; other columns are not looked at; texts without words and an empty table give no rows.
    """
    lang = F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und"))
    docs = docs.select(lang.alias("lang"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    totals, automata, bounds = gram_automata(docs, least, max_words, range_words)
    spark = docs.sparkSession
    found = None
    with small_batches(spark, AUTOMATA_ROWS):
        for size, table in enumerate(automata, start=2):
            rows = table.mapInArrow(_gram_rows(size), _GRAMS).select("lang", "words", "a")
            found = rows if found is None else found.unionByName(rows)
        candidates = materialize(found.withColumn("phrase", _joined(F.col("words"))), "candidates")
    size = F.size("words")
    at = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "a", "words", at).select("lang", "phrase", "a", "k", _joined(F.slice("words", F.lit(1), F.col("k"))).alias("left"), _joined(F.slice("words", F.col("k") + 1, size - F.col("k"))).alias("right"))
    parts = cuts.select("lang", F.col("left").alias("part")).unionByName(cuts.select("lang", F.col("right").alias("part")))
    with small_batches(spark, AUTOMATA_ROWS):
        counts = materialize(part_counts(parts, automata[: max(1, max_words - 2)], bounds), "part-counts")
    left, right = (counts.select("lang", F.col("part").alias(side), F.col("f").alias(side[0])) for side in ("left", "right"))
    wide = [F.col(c).cast("decimal(19,0)") for c in "lr"]
    a = F.col("a").cast("decimal(15,0)")
    score = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * a * a, wide[0] * wide[1])
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    kept = scored
    for inner in range(2, max_words):
        starts = F.explode(F.sequence(F.lit(1), size - inner + 1))
        within = candidates.where(size > inner).select("lang", "words", "a", starts.alias("i")).groupBy("lang", _joined(F.slice("words", F.col("i"), F.lit(inner))).alias("phrase")).agg(F.max("a").alias(f"longer{inner}"))
        kept = kept.join(within, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col(f"longer{inner}") < absorbed * F.col("a"), F.lit(True))).drop(f"longer{inner}")
    kept = kept.select("lang", "phrase", "a", "best.*")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # The best of each of a fixed number of parts of a language first, so that no task orders all of its phrases.
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part")
    kept = kept.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
