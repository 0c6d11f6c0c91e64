"""Vectorised text primitives: many texts laid end to end in one byte buffer.

Everything here is plain numpy over a ``Texts`` block, so a batch of documents
costs a fixed number of array passes and no Python work per word or per byte.

Spans of bytes are named by a seeded hash that takes eight bytes a round, each
through a 64-bit finaliser, so no structure of the text cancels. Windows of
values are named by Rabin-Karp polynomials modulo the prime 2**61 - 1: modulo a
power of two such polynomials are equal on long Thue-Morse words whatever the
base, modulo a prime two windows agree for few bases.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Seeds of hashes that only preselect or that are compared by bytes afterwards.
SEED = 0x9E3779B97F4A7C15
WORD_SEED = 0xD6E8FEB86659FD93
#: Modulus of window polynomials.
PRIME = (1 << 61) - 1
#: Bytes of a span that are hashed by array rounds; what is longer is hashed by itself.
ROUND_BYTES = 128

# Separators of words: 0x20 and 0x09 to 0x0D, the fixed class of the contracts.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Lower-casing of A-Z alone; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBEA225F9EB34556D)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBEA225F9EB34556D)
    return h ^ (h >> np.uint64(32))


class Texts:
    """Texts end to end: ``data`` uint8, ``bounds`` int64 with one entry more than texts."""

    __slots__ = ("data", "bounds")

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    @classmethod
    def of_arrow(cls, column) -> Texts:
        """From a string or binary Arrow column; null counts as empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
        if column.null_count:
            column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
        n = len(column)
        _, offsets, values = column.buffers()
        if not n:
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None else np.zeros(0, np.uint8)
        return cls(data, bounds - bounds[0])

    @classmethod
    def of_bytes(cls, texts: list[bytes]) -> Texts:
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        return cls(np.frombuffer(b"".join(texts), np.uint8), bounds)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def slices(self, most: int):
        """Sub-blocks of about ``most`` bytes, whole texts each (a longer text stands alone), with the index of the first."""
        at, n = 0, len(self)
        while at < n:
            to = int(np.searchsorted(self.bounds, self.bounds[at] + most, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield at, Texts(self.data[self.bounds[at] : self.bounds[to]], self.bounds[at : to + 1] - self.bounds[at])
            at = to


def lowered(texts: Texts) -> Texts:
    return Texts(LOWER[texts.data], texts.bounds)


class Words:
    """Words of a block: byte ``start`` and ``end`` in its data, ``first`` word of each text (one entry more than texts)."""

    __slots__ = ("start", "end", "first")

    def __init__(self, start, end, first):
        self.start, self.end, self.first = start, end, first

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: Texts) -> Words:
    """Maximal runs of bytes outside the separator class; a word never crosses texts."""
    n = len(texts.data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(IS_SPACE[texts.data], out=inside[:n])
    cut = np.zeros(n + 1, bool)
    cut[texts.bounds] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    start = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    return Words(start, end, np.searchsorted(start, texts.bounds))


#: Masks of the first 0 to 8 bytes of a little-endian number.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def eights(data: np.ndarray, laid_out: bool = True) -> np.ndarray:
    """The eight bytes from every position on (and from the end) as a little-endian number; zeros follow the end.

    ``laid_out`` takes eight times the memory of the data, and is faster to index where most of it is read.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    return view.copy() if laid_out else view


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of the bytes of each span [start, end); ``at`` may give ``eights(data)``."""
    at = eights(data) if at is None else at
    size = end - start
    state = mix(size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) ^ np.uint64(seed))
    state = mix(state ^ (at[start] & FIRST_BYTES[np.minimum(size, 8)]))
    live, off = np.flatnonzero(size > 8), 8
    while len(live) and off < ROUND_BYTES:
        taken = at[start[live] + off] & FIRST_BYTES[np.minimum(size[live] - off, 8)]
        state[live] = mix(state[live] * np.uint64(0x9FB21C651E98DF25) ^ taken)
        off += 8
        live = live[size[live] > off]
    if len(live):
        view, key = memoryview(np.ascontiguousarray(data)), seed.to_bytes(8, "little")
        spans = zip(start[live].tolist(), end[live].tolist(), strict=True)
        state[live] = np.array([int.from_bytes(hashlib.blake2b(view[a:z], digest_size=8, key=key).digest(), "little") for a, z in spans], np.uint64)
    return state


def same_spans(at: np.ndarray, start: np.ndarray, other_at: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``start`` and from ``other`` on are equal; ``at`` and ``other_at`` are ``eights`` of the data."""
    same = np.ones(len(start), bool)
    live, off = np.flatnonzero(size > 0), 0
    while len(live):
        mask = FIRST_BYTES[np.minimum(size[live] - off, 8)]
        equal = ((at[start[live] + off] ^ other_at[other[live] + off]) & mask) == 0
        same[live[~equal]] = False
        off += 8
        live = live[equal & (size[live] > off)]
    return same


def word_hashes(texts: Texts, found: Words, seed: int = WORD_SEED) -> np.ndarray:
    return span_hashes(texts.data, found.start, found.end, seed)


def chained(values: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every ``width`` consecutive values, one finaliser a value; for short windows."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    state = mix(values[:n] + np.uint64(width))
    for i in range(1, width):
        state = mix(state * np.uint64(0x9FB21C651E98DF25) ^ values[i : i + n])
    return state


def folded(x: np.ndarray) -> np.ndarray:
    """Values below 2**64 modulo the prime."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, from halves of 32 bits."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    ends = a0 * b0
    # 2**64 is 8, and 2**32 * 2**29 is 1
    total = ((a1 * b1) << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << half)
    return folded(total + (ends & np.uint64(PRIME)) + (ends >> np.uint64(61)))


_powers: dict[int, np.ndarray] = {}
#: Powers that a worker keeps of a base; longer tables, for longer texts, are made anew.
KEPT_POWERS = 1 << 18


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime; the table grows by doubling and is kept while it is small."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.concatenate([have, times(have, np.full(len(have), pow(base, len(have), PRIME), np.uint64))])
    if len(have) <= KEPT_POWERS:
        _powers[base] = have
        while len(_powers) > 4:
            del _powers[next(iter(_powers))]
    return have[:n]


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash, modulo the prime, of every ``width`` consecutive values; len(values) - width + 1 of them."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    terms = times(folded(values), powers(base, n))
    # prefix sums of halves, so that they need no reduction
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    lows, highs = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(terms & low, out=lows[1:])
    np.cumsum(terms >> half, out=highs[1:])
    high = highs[width:] - highs[:-width]
    total = (lows[width:] - lows[:-width]) + ((high & np.uint64((1 << 30) - 1)) << half) + (high >> np.uint64(30))
    return times(folded(total), powers(pow(base, -1, PRIME), n - width + 1))


def window_starts(first: np.ndarray, width: int, total: int) -> np.ndarray:
    """Mask over the ``total - width + 1`` rolling windows of those that stay inside one text."""
    n = max(0, total - width + 1)
    ok = np.ones(n, bool)
    if n and width > 1:
        edge = np.zeros(total + 1, np.int32)
        inner = first[(first > 0) & (first < total)]
        np.add.at(edge, inner, 1)
        crossings = np.cumsum(edge)
        # the window [i, i+width) crosses a boundary if a text begins in (i, i+width)
        ok = crossings[np.arange(n) + width - 1] == crossings[:n]
    return ok


def owner(first: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Text that holds each word or byte ``index``; texts without any are passed over."""
    return np.searchsorted(first, index, side="right") - 1


def merge_spans(start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted equal-width spans to maximal disjoint runs (touching spans become one)."""
    if not len(start):
        return start, start
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > start[:-1] + width
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return start[new], start[last] + width
