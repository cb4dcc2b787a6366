"""Weighted acyclic automata over words: count transducers of sorted n-grams, their union, and lookups.

An automaton reads a path of labels and each arc puts out the count of the n-gram that ends with it (0: none).  States with the
same arcs, outputs included, are one state.  Arcs are kept by depth, those of a state together and sorted by label.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textvec import mix

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Level:
    """Arcs of one depth: ``first`` arc of each state (and the end), label, output, and the state of the next depth it leads to."""

    first: np.ndarray
    label: np.ndarray
    output: np.ndarray
    target: np.ndarray


def row_keys(columns: list[np.ndarray]) -> np.ndarray:
    """A long for each row, in the order of the rows and equal for equal rows; values are at least -1."""
    key = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        radix = int(c.max(initial=0)) + 2
        if int(key.max(initial=0)) >= (1 << 62) // radix:
            key = np.unique(key, return_inverse=True)[1]
        key = key * radix + c + 1
    return key


def summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows sorted, equal ones as one with the sum of their counts."""
    key = row_keys(columns)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return [c[order[first]] for c in columns], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows, sorted, and how often each occurs; values are at least 0."""
    radix = [int(c.max(initial=0)) + 1 for c in columns]
    if math.prod(radix) >= 1 << 62:
        return summed(columns, np.ones(len(columns[0]), np.int64))
    key = columns[0].astype(np.int64)
    for c, r in zip(columns[1:], radix[1:], strict=True):
        key *= r
        key += c
    key.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    counts, key = np.diff(np.append(first, len(key))), key[first]
    out = []
    for r in radix[:0:-1]:
        key, c = np.divmod(key, r)
        out.append(c)
    return [key, *out[::-1]], counts


def build(columns: list[np.ndarray], counts: np.ndarray) -> list[Level]:
    """Automaton of distinct n-grams in sorted order: label columns by place, -1 beyond the end of a shorter n-gram.

    Each n-gram adds the arcs beyond what it shares with the one before; a state is complete once the prefix it
    stands for has passed, and is then registered: it is an earlier state if that has the same arcs.
    """
    n, depth = len(counts), len(columns)
    differs, new = np.zeros(n, bool), []
    if n:
        differs[0] = True
    for c in columns:
        differs = differs | np.concatenate([np.zeros(min(1, n), bool), c[1:] != c[:-1]])
        new.append(np.flatnonzero(differs & (c >= 0)))
    ends = np.sum([c >= 0 for c in columns], axis=0) if n else np.zeros(0, np.int64)
    levels: list[Level] = []
    target_of: np.ndarray | None = None
    for d in range(depth - 1, -1, -1):
        at = new[d]
        label, output = columns[d][at], np.where(ends[at] == d + 1, counts[at], 0)
        target = target_of if target_of is not None else np.zeros(len(at), np.int64)
        parents = new[d - 1] if d else np.zeros(1, np.int64)
        first = np.append(np.searchsorted(at, parents), len(at))
        levels.append(Level(first, label.astype(np.int64), output.astype(np.int64), target))
        if d:
            levels[-1], target_of = _registered(levels[-1])
    return levels[::-1]


def _registered(level: Level) -> tuple[Level, np.ndarray]:
    """The level with states of equal arcs as one, and the state that each has become."""
    sizes = np.diff(level.first)
    place = np.arange(len(level.label)) - np.repeat(level.first[:-1], sizes)
    h = np.zeros(len(level.label), np.uint64)
    for part in (level.label, level.output, level.target, place):
        h = mix(h * _FACTOR + part.astype(np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
    key = mix(sums[level.first[1:]] - sums[level.first[:-1]] + sizes.astype(np.uint64))
    _, index, state = np.unique(key, return_index=True, return_inverse=True)
    # A hash only proposes: arcs are compared one by one, and a state that differs stays on its own.
    model = index[state]
    same = sizes == sizes[model]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    twin = np.where(same[owner], level.first[:-1][model][owner] + place, np.arange(len(level.label)))
    unequal = (level.label != level.label[twin]) | (level.output != level.output[twin]) | (level.target != level.target[twin])
    same[owner[unequal]] = False
    own = np.flatnonzero(~same)
    if len(own):
        state[own] = len(index) + np.arange(len(own))
        index = np.concatenate([index, own])
    kept = _spread(level.first[:-1][index], sizes[index])
    first = np.concatenate([[0], np.cumsum(sizes[index])])
    return Level(first, level.label[kept], level.output[kept], level.target[kept]), state


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of ``sizes``."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def paths(levels: list[Level]) -> tuple[list[np.ndarray], np.ndarray]:
    """All n-grams with a count, in no special order: label columns, -1 beyond the end, and counts."""
    found: list[tuple[list[np.ndarray], np.ndarray]] = []
    state, prefix = np.zeros(1, np.int64), []
    for depth, level in enumerate(levels):
        sizes = level.first[state + 1] - level.first[state]
        arcs = _spread(level.first[state], sizes)
        prefix = [np.repeat(c, sizes) for c in prefix] + [level.label[arcs]]
        out = level.output[arcs]
        counted = np.flatnonzero(out)
        if len(counted):
            found.append(([c[counted] for c in prefix] + [np.full(len(counted), -1, np.int64)] * (len(levels) - depth - 1), out[counted]))
        state = level.target[arcs]
    if not found:
        return [np.zeros(0, np.int64)] * len(levels), np.zeros(0, np.int64)
    return [np.concatenate(c) for c in zip(*(f[0] for f in found), strict=True)], np.concatenate([f[1] for f in found])


def lookup(levels: list[Level], columns: list[np.ndarray]) -> np.ndarray:
    """Counts of n-grams: the composition of their acceptor with the automaton, all of them a label at a time; 0 where there is no path."""
    n = len(columns[0])
    state, count, live = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    for level, labels in zip(levels, columns, strict=False):
        live = live[labels[live] >= 0]
        radix = int(max(level.label.max(initial=0), labels.max(initial=0))) + 1
        arcs = np.repeat(np.arange(len(level.first) - 1), np.diff(level.first)) * radix + level.label
        wanted = state[live] * radix + labels[live]
        at = np.searchsorted(arcs, wanted)
        hit = at < len(arcs)
        hit[hit] = arcs[at[hit]] == wanted[hit]
        count[live[~hit]] = 0
        live, at = live[hit], at[hit]
        count[live], state[live] = level.output[at], level.target[at]
    return count


def pack(levels: list[Level], words: pa.Array) -> bytes:
    """An automaton and the words of its labels as bytes; no word holds a blank."""
    arrays = [a for lev in levels for a in (lev.first, lev.label, lev.output, lev.target)]
    small = [a.astype(np.int32) if int(a.max(initial=0)) < 1 << 31 else a for a in arrays]
    head = np.array([len(levels), *(x for a in small for x in (len(a), a.itemsize))], np.int64)
    body = zlib.compress(b"".join(a.tobytes() for a in small), 1)
    text = zlib.compress(b" ".join(words.to_pylist()), 1)
    return np.array([len(head), len(body)], np.int64).tobytes() + head.tobytes() + body + text


def unpack(data: bytes) -> tuple[list[Level], pa.Array]:
    n_head, n_body = np.frombuffer(data, np.int64, 2).tolist()
    head = np.frombuffer(data, np.int64, n_head, 16)
    at = 16 + 8 * n_head
    body, text = zlib.decompress(data[at : at + n_body]), zlib.decompress(data[at + n_body :])
    arrays, low = [], 0
    for n, size in head[1:].reshape(-1, 2).tolist():
        arrays.append(np.frombuffer(body, np.int32 if size == 4 else np.int64, n, low).astype(np.int64))
        low += n * size
    return [Level(*arrays[4 * i : 4 * i + 4]) for i in range(head[0])], pa.array(text.split(b" "), pa.large_binary())


def relabelled(columns: list[np.ndarray], words: pa.Array, by_bytes: bool = True) -> tuple[list[np.ndarray], pa.Array]:
    """Label columns over only those words that they use, in the order of their bytes or, if that is theirs already, as they are."""
    used = np.zeros(len(words) + 1, bool)
    for c in columns:
        used[c] = True  # -1, beyond the end of a shorter n-gram, is the last place
    used = np.flatnonzero(used[:-1])
    kept, place = words.take(pa.array(used)), np.full(len(words) + 1, -1, np.int64)
    place[used] = np.arange(len(used))
    if by_bytes:
        order = pc.sort_indices(kept)
        place[used[order.to_numpy(zero_copy_only=False)]] = np.arange(len(used))
        kept = kept.take(order)
    return [place[c] for c in columns], kept


def common_labels(parts: list[tuple[list[np.ndarray], np.ndarray, pa.Array]]) -> tuple[list[np.ndarray], np.ndarray, pa.Array]:
    """N-grams of several vocabularies over one sorted vocabulary: label columns, counts, words."""
    words = pa.concat_arrays([p[2] for p in parts]).dictionary_encode()
    order = pc.sort_indices(words.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy(zero_copy_only=False)] = np.arange(len(order))
    code, low, columns = rank[words.indices.to_numpy(zero_copy_only=False)], 0, []
    for cols, _, own in parts:
        place = np.append(code[low : low + len(own)], -1)  # -1 stays -1
        columns.append([place[c] for c in cols])
        low += len(own)
    return [np.concatenate(c) for c in zip(*columns, strict=True)], np.concatenate([p[1] for p in parts]), words.dictionary.take(order)
