"""Passages of a benchmark in training documents, by an FM-index of each shard of the documents.

``build_index`` writes a row for each shard of some megabytes of text: the wavelet matrix of its words, the counts of
symbols, sampled suffix positions, the vocabulary and where each document lies.  ``search_index`` runs the windows of the
benchmark's items backward through each shard, all windows at once, locates their occurrences by the sampled
positions and merges them into spans of words.  An index may be kept and searched again for other benchmarks.

A document longer than a shard is indexed in segments, each of which also has the words of a window less one on either side but reports
its own words only, so no occurrence is lost and no word counts twice.  Windows are searched in slices of a bounded size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, quoted, small_batches
from .fm_index import FmIndex, build
from .words import Words, byte_kinds, flat, split_words, text_blocks

#: Fixed value: words are runs of ASCII letters, digits and characters beyond ASCII.
WORD_BYTES = byte_kinds([b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)])
WINDOW = 10
#: Bytes of text of a shard; words of a segment of a longer document; windows searched at a time; shards read at a time.
SHARD_BYTES, SEGMENT_WORDS, SLICE_WINDOWS, SHARD_ROWS = 1 << 23, 1 << 20, 1 << 17, 4
_DOCUMENTS = "row array<long>, total array<long>, start array<long>, size array<long>, skip array<long>, own array<long>"
_SHARD = f"{_DOCUMENTS}, n long, counts binary, levels int, bits binary, marks binary, samples binary, vocabulary binary"

Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _segments(words: Words, margin: int, most: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Shards as lists of segments: document, first word and end that are indexed, first word and end that are its own."""
    held, size = [], 0
    for doc, (low, high) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        for at in range(low, max(high, low + 1), most):
            end = min(high, at + most)
            part = (doc, max(low, at - margin), min(high, end + margin), at, end)
            if held and size + part[2] - part[1] > 4 * most:
                yield held
                held, size = [], 0
            held.append(part)
            size += part[2] - part[1]
    if held:
        yield held


def _indexer(id_type: pa.DataType, window: int, segment_words: int) -> Mapper:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for block in text_blocks(batches, limit=SHARD_BYTES):
            words = split_words(block["text"], WORD_BYTES)
            for parts in _segments(words, window - 1, segment_words):
                doc, low, high, own, end = (np.array(x, np.int64) for x in zip(*parts, strict=True))
                sizes = high - low
                ids = words.ids[np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
                used, ids = np.unique(ids, return_inverse=True)
                fm = build(ids, sizes, len(used))
                first = words.first[doc]
                columns = [row + doc, words.first[doc + 1] - first, low - first, sizes, own - low, end - own]
                vocabulary = words.vocabulary.take(pa.array(used))
                arrays = [pa.array([c], pa.list_(pa.int64())) for c in columns] + [pa.array([fm.n], pa.int64()), _bytes(fm.counts), pa.array([len(fm.bits)], pa.int32()), _bytes(fm.bits), _bytes(fm.marks), _bytes(fm.samples.astype(np.uint32))]
                arrays += [pa.array([zlib.compress(b" ".join(vocabulary.to_pylist()), 1)], pa.binary())]
                ids_of = flat(block["doc_id"]).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), ids_of.cast(id_type))], names=[*(f.split()[0] for f in _SHARD.split(", ")), "doc_id"])
            row += block.num_rows

    return index


def _bytes(a: np.ndarray) -> pa.Array:
    return pa.array([a.tobytes()], pa.binary())


def build_index(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """A row for each shard of ``docs``, written to the scratch folder; any phrase of at most ``window`` words can be searched in it."""
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    type_ = rows.schema["doc_id"].dataType.simpleString()
    id_type = rows.limit(0).select("doc_id").toArrow().schema.field(0).type
    return materialize(rows.mapInArrow(_indexer(id_type, window, segment_words), f"{_SHARD}, doc_id array<{type_}>"), "fm-index")


def _loaded(r: dict) -> tuple[FmIndex, pa.Array]:
    bits = np.frombuffer(r["bits"], np.uint64).reshape(r["levels"], -1)
    fm = FmIndex(r["n"], np.frombuffer(r["counts"], np.int64), bits, np.frombuffer(r["marks"], np.uint64), np.frombuffer(r["samples"], np.uint32).astype(np.int64))
    joined = zlib.decompress(r["vocabulary"])
    return fm, pa.array(joined.split(b" ") if joined else [], pa.binary())


def _searcher(phrases) -> Mapper:
    """Spans of words that occurrences of the windows cover, and the item sets they belong to, for each document of a shard that has any."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at, sizes, sets = phrases.value
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                fm, vocabulary = _loaded(r)
                symbol = (pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy(zero_copy_only=False) + 1).astype(np.int64)
                known = np.where(at >= 0, symbol[at], 1) if len(at) else at
                may = np.flatnonzero((known > 0).all(axis=1)) if len(at) else np.empty(0, np.int64)
                if not len(may):
                    continue
                low, high = fm.search(known[may], sizes[may])
                times = np.maximum(high - low, 0)
                if not times.any():
                    continue
                place = fm.locate(np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum()))
                yield from _covered(r, place, np.repeat(sizes[may], times), np.repeat(sets[may], times))

    return search


def _covered(r: dict, place: np.ndarray, size: np.ndarray, set_: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each document with hits, from the places, sizes and sets of all occurrences in a shard."""
    row, start, sizes, skip, own = (np.array(r[c], np.int64) for c in ("row", "start", "size", "skip", "own"))
    base = np.cumsum(sizes + 1) - sizes - 1
    segment = np.searchsorted(base, place, side="right") - 1
    first, end = base + skip, base + skip + own
    # Of an occurrence that reaches over the edge of a segment's own words, the part within counts here.
    a, b = np.maximum(place, first[segment]), np.minimum(place + size, end[segment])
    inside = a < b
    a, b, segment, set_ = a[inside], b[inside], segment[inside], set_[inside]
    if not len(a):
        return
    order = np.lexsort((a, segment))
    a, b, of = a[order], b[order], segment[order]
    reach = np.maximum.accumulate(b)
    new = np.concatenate([[True], (a[1:] > reach[:-1]) | (of[1:] != of[:-1])])
    starts = np.flatnonzero(new)
    stops = reach[np.append(starts[1:], len(a)) - 1]
    seg = of[starts]
    pairs = np.unique(np.stack([segment, set_], axis=1), axis=0)
    docs, counts = np.unique(seg, return_counts=True)
    ends = np.append(0, np.cumsum(counts)).astype(np.int32)
    set_ends = np.append(0, np.cumsum(np.unique(pairs[:, 0], return_counts=True)[1])).astype(np.int32)
    shift = start[seg] - base[seg]
    spans = pa.StructArray.from_arrays([pa.array(a[starts] + shift), pa.array(stops + shift)], names=["start", "end"])
    yield pa.RecordBatch.from_arrays(
        [pa.array(row[docs]), pa.ListArray.from_arrays(pa.array(ends), spans), pa.ListArray.from_arrays(pa.array(set_ends), pa.array(pairs[:, 1]))], names=["row", "spans", "sets"]
    )


def _windows_of(window: int) -> Mapper:
    """(item, window): runs of ``window`` words of each item, all its words where it has fewer, joined by blanks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=1 << 20):
            words = split_words(block["text"], WORD_BYTES)
            vocabulary = words.vocabulary.to_pylist()
            for doc, (low, high) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                if low == high:
                    continue
                all_ = [vocabulary[i] for i in words.ids[low:high].tolist()]
                found = list(dict.fromkeys(b" ".join(all_[i : i + window]) for i in range(max(1, len(all_) - window + 1))))
                yield pa.RecordBatch.from_arrays([flat(block["item"].slice(doc, 1)).take(pa.array([0] * len(found))), pa.array(found, pa.binary()).cast(pa.string())], names=["item", "window"])

    return cut


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(window, set_id) and (set_id, item): the distinct windows, and the items of each set of items that share one.

    A set has one row for each item; items without an id are in none, though their windows count.
    """
    items = benchmark.select(F.col(quoted(id_col)).cast("string").alias("item"), F.col(quoted(text_col)).cast("string").alias("text"))
    cut = items.mapInArrow(_windows_of(window), "item string, window string")
    shared = materialize(cut.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")), "windows")
    sets = materialize(shared.select("items").distinct().withColumn("set_id", F.monotonically_increasing_id()), "item-sets")
    return materialize(shared.join(sets, "items").select("window", "set_id"), "window-sets"), sets.select("set_id", F.explode("items").alias("item"))


def search_index(index: DataFrame, windows: DataFrame, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """(row, spans, sets) of the documents of an index in which ``windows`` (window, set_id) occur; one row for each segment and slice of windows."""
    spark = index.sparkSession
    slices = max(1, math.ceil(windows.count() / slice_windows))
    parts = []
    for k in range(slices):
        own = windows.where(F.pmod(F.xxhash64("window"), F.lit(slices)) == k).toArrow() if slices > 1 else windows.toArrow()
        texts = [w.split(b" ") for w in flat(own["window"]).cast(pa.binary()).to_pylist()]
        sizes = np.array([len(w) for w in texts], np.int64)
        coded = pa.array([x for w in texts for x in w], pa.binary()).dictionary_encode()
        at = np.full((len(texts), int(sizes.max(initial=0))), -1, np.int64)
        at[np.arange(at.shape[1]) < sizes[:, None]] = coded.indices.to_numpy(zero_copy_only=False)
        phrases = spark.sparkContext.broadcast((coded.dictionary, at, sizes, own["set_id"].to_numpy()))
        with small_batches(spark, SHARD_ROWS):
            parts.append(materialize(index.mapInArrow(_searcher(phrases), "row long, spans array<struct<start: long, end: long>>, sets array<long>"), "hits"))
        phrases.unpersist()
    return reduce(DataFrame.unionByName, parts)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", segment_words: int = SEGMENT_WORDS, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """(id, n_words, spans, items) for each row of ``docs``: merged spans of words to remove, and the ids (as strings, sorted) of the items found.

    A span has the places of its first word and of the word after its last.  A null or empty text has no words; an
    item without words has no window; rows that repeat, also with the same id or none, are documents of their own; an
    item without an id counts for spans only; other columns are not looked at; without documents there are no rows, and without
    items no spans.
    """
    index = build_index(docs, window, id_col, text_col, segment_words)
    windows, sets = benchmark_windows(benchmark, window, item_col, item_text_col)
    hits = search_index(index, windows, slice_windows)
    order = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select("row", F.inline("spans")).withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1))
    spans = spans.withColumn("span", F.sum("new").over(order)).groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    items = hits.select("row", F.explode("sets").alias("set_id")).distinct().join(sets, "set_id")
    items = items.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    documents = index.select(F.inline(F.arrays_zip("row", "doc_id", "total", "start"))).where("start = 0")
    out = documents.join(spans, "row", "left").join(items, "row", "left")
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return out.select(F.col("doc_id").alias(id_col), F.col("total").alias("n_words"), F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
