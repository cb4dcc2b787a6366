"""Sequence packing: shortest-pack-first over the length histogram, joined back by rank.

Documents are tokenised once; each becomes pieces of at most ``max_len`` tokens.  Only the
histogram of piece lengths (``max_len`` counts, whatever the corpus) comes to the driver.
There lengths are placed longest first, each into the pattern with the most room, by whole
groups of equal patterns; a pattern that would leave padding is cut so that its parts have
power-of-two lengths.  A piece's rank within its length is its place in its task, counted while
it is cut, plus the pieces of that length in the tasks before, so nothing is sorted; its slot
is found by binary search in the table of rank ranges.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import flag_members, materialize, quoted

MAX_LEN = 2048
END_ID = 1
#: A sequence short of ``max_len`` by at most this share stays whole and is padded.
PAD_SHARE = 0.01
#: ``monotonically_increasing_id`` has the number of the task above this bit.
_TASK_BIT = 33


@lru_cache(maxsize=1)
def _encoder(path: str) -> Callable[[str], list[int]]:
    """Ids that ``tokenizers`` gives with the vocabulary file at ``path`` and ``add_special_tokens=False``.

    A rank file of the same name beside it gives the same ids in a third of the time, with the file's
    added tokens found in texts as there; added tokens with options of their own are left to ``tokenizers``.
    """
    import json
    import os

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks_path):
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t["content"]: t["id"] for t in added}
            encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            return lambda text: encoding.encode(text, allowed_special="all") if any(t in text for t in special) else encoding.encode_ordinary(text)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def _token_ids(encode: Callable[[str], list[int]], text: str | None) -> np.ndarray:
    return np.array([*encode(text or ""), END_ID], dtype="<u4")


#: What a piece has of its document, and its own numbers.
_DOC, _PIECE = ("doc", "h1", "h2", "row"), ("start", "length", "crc", "total", "within")


def _piece_maker(path: str, max_len: int, with_ids: bool):
    """(doc, h1, h2, row, text) -> a row for each piece; ``within`` counts the pieces of its length before it in the task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = _encoder(path), np.zeros(max_len + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                of, numbers, own_ids = [], [], []
                for i, text in enumerate(part.column(4).to_pylist()):
                    ids = _token_ids(encode, text)
                    for start in range(0, len(ids), max_len):
                        own = ids[start : start + max_len].tobytes()
                        length = len(own) // 4
                        of.append(i)
                        numbers.append((start, length, zlib.crc32(own), len(ids), int(seen[length])))
                        seen[length] += 1
                        if with_ids:
                            own_ids.append(own)
                arrays = [part.column(c).take(pa.array(of, pa.int32())) for c in range(4)] + [pa.array(x, pa.int64()) for x in zip(*numbers, strict=True)]
                names = [*_DOC, *_PIECE]
                if with_ids:
                    arrays, names = [*arrays, pa.array(own_ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return pieces


def shortest_pack_first(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, list[int]]]:
    """Patterns (count, piece lengths) that use each length exactly as often as the histogram says.

    Lengths go longest first into the pattern with the least in it; a group of equal
    patterns is filled as a whole or split once, so there are at most twice as many
    patterns as lengths.
    """
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s in room if s >= length), default=None)
            if space is None:
                room[max_len - length].append((left, [length]))
                break
            count, lengths = room[space].pop()
            if not room[space]:
                del room[space]
            used = min(count, left)
            if used < count:
                room[space].append((count - used, lengths))
            room[space - length].append((used, [*lengths, length]))
            left -= used
    return [p for patterns in room.values() for p in patterns]


def _targets(total: int, max_len: int) -> list[int]:
    """Lengths of the sequences that a pattern of ``total`` tokens makes."""
    if total >= max_len * (1 - PAD_SHARE) or total & (total - 1) == 0:
        return [total]
    return [1 << b for b in range(max_len.bit_length(), -1, -1) if total >> b & 1]


def slot_table(histogram: dict[int, int], max_len: int = MAX_LEN) -> dict[str, np.ndarray]:
    """Rank ranges and where they go, a row for each part of a slot.

    Pieces of ``length`` with ``first_rank <= rank < end_rank`` put the ``part_len`` tokens from
    ``part_start`` at ``offset`` of sequence ``first_seq + (rank - first_rank) * step``.
    Sorted by length, then first rank.
    """
    next_rank: dict[int, int] = defaultdict(int)
    rows, next_seq = [], 0
    for count, lengths in shortest_pack_first(histogram, max_len):
        targets = _targets(sum(lengths), max_len)
        step, seq, used = len(targets), 0, 0
        for length in lengths:
            first = next_rank[length]
            next_rank[length] += count
            done = 0
            while done < length:
                take = min(length - done, targets[seq] - used)
                rows.append((length, first, first + count, done, take, next_seq + seq, step, used))
                done += take
                used += take
                if used == targets[seq]:
                    seq, used = seq + 1, 0
        next_seq += step * count
    names = ("length", "first_rank", "end_rank", "part_start", "part_len", "first_seq", "step", "offset")
    table = np.array(sorted(rows, key=lambda r: (r[0], r[1], r[3])), dtype=np.int64).reshape(-1, len(names))
    return dict(zip(names, table.T, strict=True))


def _placer(table):
    """A piece with its rank -> its parts with sequence and offset; crc is null where cut."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        # All rank ranges of one slot have its parts one after another: find the first and the last.
        key = t["length"] << 44 | t["first_rank"]
        for batch in batches:
            names = batch.schema.names
            col = {n: batch.column(names.index(n)).to_numpy(zero_copy_only=False) for n in ("start", "length", "crc", "total", "rank")}
            last = np.searchsorted(key, col["length"] << 44 | col["rank"], side="right")
            first = np.searchsorted(key, key[last - 1], side="left") if len(last) else last
            parts = last - first
            of = np.repeat(np.arange(batch.num_rows), parts)
            at = np.repeat(first - (np.cumsum(parts) - parts), parts) + np.arange(len(of))
            out = {n: batch.column(i).take(pa.array(of)) for i, n in enumerate(names) if n in _DOC}
            out |= {
                "start": pa.array(col["start"][of] + t["part_start"][at]),
                "length": pa.array(t["part_len"][at]),
                "crc": pa.array(col["crc"][of], mask=t["part_len"][at] != col["length"][of]),
                "total": pa.array(col["total"][of]),
                "sequence_id": pa.array(t["first_seq"][at] + (col["rank"][of] - t["first_rank"][at]) * t["step"][at]),
                "offset": pa.array(t["offset"][at]),
            }
            if "ids" in names:
                ids = batch.column(names.index("ids")).to_pylist()
                cut = [ids[r][4 * i : 4 * (i + n)] for r, i, n in zip(of, t["part_start"][at], t["part_len"][at], strict=True)]
                out |= {"crc": pa.array([zlib.crc32(x) for x in cut], pa.int64()), "ids": pa.array(cut, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return place


def _crc_maker(path: str):
    """(h1, h2, text, cuts) -> (h1, h2, start, length, crc) of each cut part."""

    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            out = []
            for h1, h2, text, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = _token_ids(encode, text)
                out += [(h1, h2, c["start"], c["length"], zlib.crc32(ids[c["start"] : c["start"] + c["length"]].tobytes())) for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [()] * 5)], names=["h1", "h2", "start", "length", "crc"])

    return crcs


def _digests(text: Column) -> list[Column]:
    """128 bits of a text's digest: what a text is known by over several scans, however the table is split."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_len: int = MAX_LEN,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its token ids and then ``END_ID``; null text is empty and gives the end id
    alone.  Rows that repeat an id, or have a null one, are documents of their own.  An empty
    table gives no rows.  Other columns are left out.  ``ids`` holds little-endian unsigned
    32-bit integers.  Documents are numbered in one scan, which is written; texts with cut pieces
    are read again and found by their digest.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(quoted(id_col)).alias("doc"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    of_doc = f"doc {texts.schema['doc'].dataType.simpleString()}, h1 long, h2 long, row long, start long, length long, crc long, total long"
    extra = ", ids binary" if with_ids else ""
    numbered = texts.select("doc", *_digests(F.col("text")), F.monotonically_increasing_id().alias("row"), "text")
    pieces = numbered.mapInArrow(_piece_maker(tokenizer_path, max_len, with_ids), f"{of_doc}, within long{extra}")
    pieces = materialize(pieces.withColumn("task", F.shiftright("row", _TASK_BIT).cast("int")), "pieces")

    counts = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialize(counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("before")), "offsets")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slot_table(histogram, max_len))

    ranked = pieces.join(offsets, ["length", "task"]).withColumn("rank", F.col("before") + F.col("within"))
    ranked = ranked.select("doc", "h1", "h2", "start", "length", "crc", "total", "rank", *(["ids"] if with_ids else []))
    placed = ranked.mapInArrow(_placer(table), f"{of_doc.replace(' row long,', '')}, sequence_id long, offset long{extra}")
    if not with_ids:
        placed = materialize(placed, "placed")
        table.destroy()
        cuts = placed.where("crc IS NULL").select("h1", "h2", "start", "length").distinct()
        cuts = materialize(cuts.groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "length")).alias("cuts")), "cuts")  # the parts of one text
        marked = flag_members(texts.select("text"), F.struct(*_digests(F.col("text"))), cuts, F.struct("h1", "h2"), "flag").where("flag")
        crcs = marked.select(*_digests(F.col("text")), "text").join(cuts, ["h1", "h2"]).mapInArrow(_crc_maker(tokenizer_path), "h1 long, h2 long, start long, length long, crc long")
        crcs = materialize(crcs.distinct(), "crcs")
        cut = placed.where("crc IS NULL").drop("crc").join(crcs, ["h1", "h2", "start", "length"])
        placed = placed.where("crc IS NOT NULL").unionByName(cut)
    return placed.select(
        F.col("doc").alias(id_col),
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        F.col("total").alias("doc_tokens"),
        "sequence_id",
        "offset",
        *(["ids"] if with_ids else []),
    )


def assemble(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, pieces): the sequences of ``pack_documents(..., with_ids=True)`` as token arrays.

    A sequence has at most ``max_len`` tokens, so each group is small.
    """
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "start", "length", F.col(id_col).alias("id"), "ids"))).alias("parts"))
    joined = F.hex(F.concat(F.lit(b""), F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))))
    digits = F.transform(
        F.sequence(F.lit(0), (F.length(joined) / 8 - 1).cast("int")),
        lambda i: F.conv(F.concat(*[F.substring(joined, i * 8 + k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("int"),
    )
    return parts.select("sequence_id", digits.alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("pieces"))
