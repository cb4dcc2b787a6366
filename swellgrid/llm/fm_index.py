"""FM-index over sequences of word ids: suffix order, wavelet matrix with ranks, backward search, sampled positions.

All of it is array arithmetic over one shard, whose size its caller bounds; many phrases are searched, and many hits located, at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Every so many positions of a sequence, and its first, are sampled.
SAMPLE = 32


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes.  ``symbols`` are at least 0; each place in ``ends`` closes a sequence with an end mark of its own,
    below all symbols and rising, so that equal sequences have suffixes in the order of the sequences.

    Prefix doubling: the first sort takes as many symbols as 63 bits hold, each later one twice as many, and only among
    suffixes that are still equal.
    """
    n = len(symbols)
    key = symbols.astype(np.int64) + len(ends)
    key[ends] = np.arange(len(ends))
    bits = max(1, int(key.max(initial=0)).bit_length())
    depth = max(1, 63 // bits)
    packed = key.copy()
    for k in range(1, depth):
        packed <<= bits
        packed[: max(0, n - k)] |= key[k:]
    order = np.argsort(packed)
    slots, groups, depth_keys = np.arange(n), np.zeros(n, np.int64), packed[order]
    places = order
    while True:
        new = np.concatenate([np.ones(min(1, len(slots)), bool), depth_keys[1:] != depth_keys[:-1]])
        groups[places] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        alone = new & np.concatenate([new[1:], np.ones(min(1, len(slots)), bool)])
        slots = slots[~alone]
        if not len(slots):
            return order
        places = order[slots]
        pair = groups[places] * n + groups[places + depth]
        again = np.argsort(pair)
        places, depth_keys = places[again], pair[again]
        order[slots] = places
        depth *= 2


@dataclass
class FmIndex:
    """``n`` places over symbols 0 (end mark) to ``counts`` - 2; ``counts[c]`` are the places of smaller symbols than ``c``.

    ``bits``: a row of 64-bit words for each level of the wavelet matrix, from the highest bit; ``marks``: which rows have a
    sampled position, in ``samples``.
    """

    n: int
    counts: np.ndarray
    bits: np.ndarray
    marks: np.ndarray
    samples: np.ndarray
    _ranks: np.ndarray = field(init=False)
    _mark_ranks: np.ndarray = field(init=False)
    _zeros: np.ndarray = field(init=False)
    _low: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self._ranks, self._mark_ranks = _before(self.bits), _before(self.marks)
        self._zeros = self.n - self._ranks[:, -1] - np.bitwise_count(self.bits[:, -1])
        # Where a symbol starts in the last level, which has the symbols in the order of their reversed bits.
        symbols = np.arange(len(self.counts) - 1)
        mirrored = np.zeros_like(symbols)
        for level in range(len(self.bits)):
            mirrored |= (symbols >> level & 1) << (len(self.bits) - 1 - level)
        order = np.argsort(mirrored)
        sizes = np.diff(self.counts)[order]
        self._low = np.empty(len(symbols), np.int64)
        self._low[order] = np.cumsum(sizes) - sizes

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self._ranks[level][word] + np.bitwise_count(self.bits[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def _follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Row of the suffix that starts with ``symbol`` before the place ``at``: C + rank."""
        i = at
        for level in range(len(self.bits)):
            ones = self._ones(level, i)
            i = np.where(symbol >> (len(self.bits) - 1 - level) & 1, self._zeros[level] + ones, i - ones)
        return self.counts[symbol] + i - self._low[symbol]

    def _step_back(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix one place earlier."""
        i, symbol = row, np.zeros(len(row), np.int64)
        for level in range(len(self.bits)):
            bit = (self.bits[level][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, i)
            i = np.where(bit == 1, self._zeros[level] + ones, i - ones)
            symbol = symbol << 1 | bit
        return self.counts[symbol] + i - self._low[symbol]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the suffixes that start with each phrase (a row of ``phrases``, ``sizes`` symbols of at least 1, none 0)."""
        last = phrases[np.arange(len(sizes)), sizes - 1]
        low, high = self.counts[last].astype(np.int64), self.counts[last + 1].astype(np.int64)
        live = np.flatnonzero((sizes > 1) & (high > low))
        for step in range(1, phrases.shape[1]):
            if not len(live):
                break
            symbol = phrases[live, sizes[live] - 1 - step]
            both = self._follow(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = both[: len(live)], both[len(live) :]
            live = live[(high[live] > low[live]) & (sizes[live] > step + 1)]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the shard at which the suffix of each row starts."""
        out, live, row, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        while len(live):
            word, bit = row >> 6, (row & 63).astype(np.uint64)
            found = (self.marks[word] >> bit & np.uint64(1)).astype(bool)
            w, b = word[found], bit[found]
            out[live[found]] = self.samples[self._mark_ranks[w] + np.bitwise_count(self.marks[w] & ((np.uint64(1) << b) - np.uint64(1)))] + steps
            live, row = live[~found], row[~found]
            row = self._step_back(row) if len(row) else row
            steps += 1
        return out


def _before(bits: np.ndarray) -> np.ndarray:
    """Ones before each word."""
    ones = np.bitwise_count(bits).astype(np.int64)
    return np.cumsum(ones, axis=-1) - ones


def packed_bits(flags: np.ndarray) -> np.ndarray:
    """Flags in 64-bit words, with room for one more."""
    out = np.zeros(len(flags) // 64 + 1, np.uint64)
    raw = np.packbits(flags, bitorder="little")
    out.view(np.uint8)[: len(raw)] = raw
    return out


def build(ids: np.ndarray, sizes: np.ndarray, n_ids: int, sample: int = SAMPLE) -> FmIndex:
    """Index of sequences of ``sizes`` ids each, one after the other in ``ids``; symbol 0 is the end mark, id k is symbol k + 1."""
    ends = np.cumsum(sizes + 1) - 1
    n = len(ids) + len(sizes)
    symbols = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    inside[ends] = False
    symbols[inside] = ids + 1
    order = suffix_order(symbols, ends)
    sampled = np.arange(n) % sample == 0
    sampled[ends - sizes] = True
    marks = sampled[order]
    level_bits = max(1, int(n_ids).bit_length())
    current, levels = symbols[order - 1].astype(np.uint32), []
    for level in range(level_bits):
        bit = (current >> np.uint32(level_bits - 1 - level) & np.uint32(1)).astype(bool)
        levels.append(packed_bits(bit))
        current = np.concatenate([current[~bit], current[bit]])
    counts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_ids + 1))])
    return FmIndex(n, counts, np.stack(levels), packed_bits(marks), order[marks])
