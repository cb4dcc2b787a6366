"""Words of a text column as dictionary-encoded Arrow arrays, a block of texts at a time; bounded bitmaps of hashed keys.

Everything works on the UTF-8 bytes with numpy and Arrow kernels: no text and no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import mix

#: Bytes of text that are split at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 24
WORD, BLANK, STOP = 0, 1, 2
#: Bits of a bitmap for each key, and at most (16 MB): with more keys it lets more through, and never drops a key.
BITS_PER_KEY, MOST_BITS = 10, 1 << 27
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_kinds(blanks: Iterable[int], stops: Iterable[int] = ()) -> np.ndarray:
    """Kind of each byte: ``WORD`` but for blanks, which end a word, and stops, which end a piece too."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(blanks)] = BLANK
    kinds[list(stops)] = STOP
    return kinds


@dataclass
class Words:
    """The words of some texts: ``ids`` into ``vocabulary``, the first word of each text (and the end), the piece of each word."""

    ids: np.ndarray
    vocabulary: pa.LargeBinaryArray
    first: np.ndarray
    piece: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Rows in tables of about ``limit`` bytes of text, whatever the size of the batches; a longer text comes alone."""
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.append(np.flatnonzero(np.diff(ends // limit)) + 1, b.num_rows)
        low = 0
        for cut in cuts.tolist():
            if cut > low:
                held.append(b.slice(low, cut - low))
                size += int(ends[cut - 1] - (ends[low - 1] if low else 0))
                low = cut
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _buffers(a: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of an array without nulls."""
    _, at, data = a.buffers()
    offsets = np.frombuffer(at, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(a) else np.empty(0, np.uint8)
    return offsets - offsets[0], bytes_


def as_binary(column: pa.ChunkedArray | pa.Array) -> pa.LargeBinaryArray:
    """A string or binary column as bytes; null is empty."""
    a = flat(column)
    return pc.fill_null(a.cast(pa.large_binary()), b"")


def split_words(texts: pa.ChunkedArray | pa.Array, kinds: np.ndarray) -> Words:
    """Words of each text with A-Z lower-cased; null is empty."""
    offsets, data = _buffers(as_binary(texts))
    kind = kinds[data]
    inside = kind == WORD
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[edges] = inside[edges]
    at = np.flatnonzero(starts)
    packed = _LOWER[data[inside]]
    ends = np.append(np.flatnonzero(starts[inside]), len(packed)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    first = np.searchsorted(at, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    stops = np.flatnonzero(kind == STOP)
    return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, first, np.searchsorted(stops, at) + text)


def hashes(words: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """64-bit hash of each string."""
    offsets, data = _buffers(as_binary(words))
    sizes = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max(initial=0)), _BASE, np.uint64)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[place], dtype=np.uint64)])
    return mix(total[offsets[1:]] - total[offsets[:-1]] + sizes.astype(np.uint64))


def chained(hash_: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hash of a sequence from that of all but its last member and that of the last."""
    return mix(hash_ * _MIX + following)


@dataclass
class Bitmap:
    """Which hashed keys may be in a set: never false for a member."""

    words: np.ndarray

    def may_hold(self, hash_: np.ndarray) -> np.ndarray:
        pos = hash_ & np.uint64(len(self.words) * 64 - 1)
        return (self.words[(pos >> np.uint64(6)).astype(np.int64)] >> (pos & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(keys: DataFrame, column: str, n: int) -> Bitmap:
    """Bitmap of about ``n`` hashes in a long column: 10 bits a key, 16 MB at most."""
    bits = min(MOST_BITS, max(1 << 12, 1 << max(0, BITS_PER_KEY * n - 1).bit_length()))
    pos = keys.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("p"))
    rows = pos.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("b")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return Bitmap(words.view(np.uint64))
