"""Vectorised word and shingle hashing over blocks of texts, and consistent weighted samples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text that are hashed at a time; a longer text is a block of its own.
BLOCK_BYTES = 250_000

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Word bytes: ASCII letters and digits, and every byte of other characters.
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: 0 blank or control, 1 word, 2 other visible character.
_KIND = np.where(_WORD, 1, np.where(np.arange(256) > 32, 2, 0)).astype(np.int8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(rows: Iterable[tuple], limit: int = BLOCK_BYTES, lower: bool = True) -> Iterator[tuple[list, list[bytes]]]:
    """Group (key, text) into blocks of about ``limit`` bytes of UTF-8, by default in lower case; null is empty."""
    keys, texts, size = [], [], 0
    for key, text in rows:
        text = text or ""
        b = (text.lower() if lower else text).encode("utf-8", "replace")
        keys.append(key)
        texts.append(b)
        size += len(b)
        if size >= limit:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _runs(buf: np.ndarray, kind: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each maximal run of bytes of one non-zero kind, and the index of its text."""
    inside = kind != 0
    edge = np.diff(kind, prepend=np.int8(0)) != 0
    starts = np.flatnonzero(edge & inside)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    changes = np.append(np.flatnonzero(edge), len(kind))
    ends = changes[np.searchsorted(changes, starts, side="right")]
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max()), _BASE, np.uint64)]))
    words = np.add.reduceat(_BYTE[buf[inside]] * power[place], first)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return mix(words + sizes.astype(np.uint64)), np.searchsorted(text_ends, starts, side="right")


def text_rows(batches: Iterable, size: int = 256) -> Iterator[tuple]:
    """(key, text) of Arrow batches; only ``size`` texts at a time become Python strings."""
    for b in batches:
        for i in range(0, b.num_rows, size):
            part = b.slice(i, size)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word (run of letters and digits), and the index of its text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    return _runs(buf, _WORD[buf].view(np.int8), texts)


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word or run of other visible characters, and the index of its text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    return _runs(buf, _KIND[buf], texts)


def shingle_hashes(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words, and its text; a shorter text has one shingle of all its words."""
    words, of = word_hashes(texts)
    n = len(words)
    if not n:
        return words, of
    full = np.zeros(n, dtype=bool)
    full[: max(0, n - width + 1)] = of[: max(0, n - width + 1)] == of[width - 1 :] if n >= width else False
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, n)):
        part = words[k:] * _PLACE[k]
        part[of[k:] != of[: n - k]] = 0
        total[: n - k] += part
    counts = np.bincount(of, minlength=len(texts))
    is_first = np.concatenate([[True], of[1:] != of[:-1]])
    take = full | (is_first & (counts[of] < width))
    return mix(total[take]), of[take]


def per_text(hashes: np.ndarray, of: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The hashes of each of ``n`` texts in turn."""
    bounds = np.searchsorted(of, np.arange(n + 1))
    for i in range(n):
        yield hashes[bounds[i] : bounds[i + 1]]


class WeightedSampler:
    """Improved consistent weighted sampling (Ioffe 2010) of (feature, level) sets.

    A weight is ``2 ** (level / STEPS)``.  For hash function j a feature draws its
    r, c ~ Gamma(2, 1) and beta ~ U(0, 1) from one fixed table of ``SLOTS`` draws, at a
    slot that j's multiplier gives; the ln(a) of each draw is tabulated once a level, so
    that a sample costs one look-up per feature.  Equal (feature, t) pairs make
    equal samples, and two sets agree in a sample with the chance of their weighted
    Jaccard similarity.
    """

    STEPS, SLOTS = 16, 1 << 17
    #: Tables that are held at a time; a text rarely uses more than a few levels.
    HELD = 48

    def __init__(self, samples: int = 64, seed: int = 7):
        rng = np.random.default_rng(seed)
        self._r, c = rng.gamma(2.0, 1.0, self.SLOTS), rng.gamma(2.0, 1.0, self.SLOTS)
        self._ln_c, self._beta = np.log(c), rng.random(self.SLOTS)
        self._tables: dict[int, np.ndarray] = {}
        self._mult = rng.integers(1, 2**63, samples, dtype=np.uint64) | np.uint64(1)
        self._shift = np.uint64(64 - self.SLOTS.bit_length() + 1)
        self.samples = samples

    def _t(self, level: np.ndarray | int, slot: np.ndarray | slice) -> np.ndarray:
        return np.floor(level * (np.log(2.0) / self.STEPS) / self._r[slot] + self._beta[slot])

    def _ln_a(self, level: int) -> np.ndarray:
        if level not in self._tables:
            if len(self._tables) >= self.HELD:
                self._tables.clear()
            every = slice(None)
            self._tables[level] = (self._ln_c - self._r * (self._t(level, every) - self._beta + 1)).astype(np.float32)
        return self._tables[level]

    def signature(self, hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """One int32 per sample; ``hashes`` distinct, sorted and not empty."""
        best = np.full(self.samples, np.inf, np.float32)
        winner = np.zeros(self.samples, np.uint64)
        rank = np.zeros(self.samples, np.int64)
        for level in np.unique(levels):
            table, own = self._ln_a(int(level)), hashes[levels == level]
            for i in range(0, len(own), 1024):
                h = own[i : i + 1024]
                slot = ((h * self._mult[:, None]) >> self._shift).astype(np.int32)
                a = table[slot]
                k = a.argmin(axis=1)
                low = a[np.arange(self.samples), k]
                # Of equal draws the smallest hash wins, in whatever order the levels come.
                better = (low < best) | ((low == best) & (h[k] < winner))
                best[better], winner[better], rank[better] = low[better], h[k][better], level
        slot = ((winner * self._mult) >> self._shift).astype(np.int64)
        out = mix(winner + self._t(rank, slot).astype(np.int64).view(np.uint64) * _PLACE[0])
        return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)
