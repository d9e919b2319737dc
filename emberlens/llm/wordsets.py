"""Sets of word n-grams of many texts at once: numpy works on stretches of texts, not on each text by itself."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The lowest 0 to 8 bytes of eight.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)
#: Bytes of texts that are worked on at once: what is made of them then stays in a core's cache. A longer text is a stretch of its own.
STRETCH = 1 << 20
#: Texts of a stretch; their numbers take 16 bits, as such are sorted in linear time.
TEXTS = 1 << 16
#: Longer words are hashed one by one.
LONG = 64
#: Words are counted by so many bits of their hashes, so what tasks look up has one size whatever the input.
BITS = 20
CELLS = 16


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def by_owner(owner: np.ndarray, order: np.ndarray) -> np.ndarray:
    """order, dealt to owners (16 bits) in turn: rows of one owner stay as order has them."""
    return order[np.argsort(owner[order], kind="stable")]


def stretches(texts: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """First text and the one after the last; their bytes, A-Z lower-cased; where each text begins in these, and the end."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(data) if data is not None else memoryview(b"")
    i = 0
    while i < len(texts):
        j = min(max(i + 1, int(np.searchsorted(at, at[i] + STRETCH, "right")) - 1), i + TEXTS, len(texts))
        yield i, j, bytes(data[at[i] : at[j]]).lower(), at[i : j + 1] - at[i]
        i = j


def word_hashes(text: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without ASCII white space) of the texts that begin at bounds, and where each text's words begin, with the end."""
    space = np.ones(len(text) + 2, bool)
    space[1:-1] = _SPACE[np.frombuffer(text, np.uint8)]
    cut = np.zeros(len(text) + 1, bool)
    cut[bounds] = True
    inside = ~space[1:-1]
    starts = np.flatnonzero(inside & (space[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside & (space[2:] | cut[1:])) + 1
    size = ends - starts
    eight = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), 0, (1,))  # the eight bytes from each place on
    h = mixed((size.astype(_U) * _U(_MIX[0])) ^ (eight[starts] & _LOW[np.minimum(size, 8)]))
    more, at = np.flatnonzero(size > 8), 8
    while len(more) and at < LONG:
        left = size[more] - at
        h[more] = mixed(h[more] ^ (eight[starts[more] + at] & _LOW[np.minimum(left, 8)]))
        more, at = more[left > 8], at + 8
    for i in more:
        h[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]])
    return h, np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n-word window; with fewer words, of the whole sequence."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, k, _U)
    for i in range(k):
        h = mixed(h * _U(_MIX[0]) + words[i : len(words) - k + 1 + i])
    return h


def windowed_min(a: np.ndarray, n: int) -> np.ndarray:
    k = min(n, len(a))
    out = a[: len(a) - k + 1]
    for i in range(1, k):
        out = np.minimum(out, a[i : len(a) - k + 1 + i])
    return out


def cell_of(words: np.ndarray) -> np.ndarray:
    return (words >> _U(64 - BITS)).astype(np.int64)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Of each cell's count, its place among all, in 16 bits: rarer words first."""
    out = np.empty(len(counts), np.uint16)
    out[np.argsort(counts, kind="stable")] = np.arange(len(counts)) * 65536 // max(1, len(counts))
    return out


class Sets(NamedTuple):
    """Texts' sets one after another: the n-grams' hashes in ascending order, where each text's begin, with the end, and the n-grams' ranks."""

    tokens: np.ndarray
    bounds: np.ndarray
    owner: np.ndarray
    rank: np.ndarray | None

    def keys(self) -> list[int | None]:
        """Equal sets have equal keys; an empty one has none."""
        data, at = memoryview(self.tokens.tobytes()), (8 * self.bounds).tolist()
        return [xxhash.xxh3_64_intdigest(data[a:b]) - (1 << 63) if b > a else None for a, b in zip(at, at[1:], strict=False)]

    def cells(self) -> np.ndarray:
        """How many of each set's hashes begin with each of 16 values of four bits."""
        return np.bincount(self.owner.astype(np.int64) * CELLS + (self.tokens >> _U(60)).astype(np.int64), minlength=CELLS * (len(self.bounds) - 1)).reshape(-1, CELLS)

    def rare_first(self) -> np.ndarray:
        """tokens with each text's rarest first."""
        return self.tokens[by_owner(self.owner, np.argsort(self.rank, kind="stable"))]


def sets_of_words(words: np.ndarray, at: np.ndarray, n: int, rank: np.ndarray | None = None) -> Sets:
    """rank: of cells of words; an n-gram's is that of its rarest word."""
    m = np.diff(at)
    count = np.where(m >= n, m - n + 1, m > 0)
    owner = np.repeat(np.arange(len(m)).astype(np.uint16), count)
    place = np.arange(len(owner)) + np.repeat(at[:-1] - (np.cumsum(count) - count), count)
    of = None if rank is None else rank[cell_of(words)]
    h, r = np.empty(len(owner), _U), None if of is None else np.empty(len(owner), of.dtype)
    if (m >= n).any():
        use = np.repeat(m >= n, count)
        h[use] = shingles(words, n)[place[use]]
        if of is not None:
            r[use] = windowed_min(of, n)[place[use]]
    for k in np.unique(m[(m > 0) & (m < n)]):  # texts of fewer words are one window
        use = np.repeat(m == k, count)
        at_k = place[use][:, None] + np.arange(k)
        g = np.full(len(at_k), k, _U)
        for i in range(k):
            g = mixed(g * _U(_MIX[0]) + words[at_k[:, i]])
        h[use] = g
        if of is not None:
            r[use] = of[at_k].min(axis=1)
    order = by_owner(owner, np.argsort(h))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return Sets(h, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(m))))), owner, None if r is None else r[order][new])


def sets_of_texts(texts: pa.Array, n: int, rank: np.ndarray | None = None) -> Iterator[tuple[int, int, Sets]]:
    """The sets of binary texts, by stretches: first text, the one after the last, their sets."""
    for i, j, text, bounds in stretches(texts):
        words, at = word_hashes(text, bounds)
        yield i, j, sets_of_words(words, at, n, rank)
