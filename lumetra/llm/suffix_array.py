"""Blockwise suffix sorting with a difference cover.

A difference cover D modulo v has, for any two positions, a shift below v that
puts both at sample positions (position modulo v in D). The samples are ranked
once; then the wanted suffixes are sorted one bucket of leading bytes at a
time, by their first v bytes and, where those tie, by the sample ranks at the
common shift. Ties need v bytes of comparison and one look-up however long
they are, so memory is bounded by the block and one bucket.

Sample ranks come from the leading v bytes and are doubled (a sample and the
one as far on as is settled) until all differ, or to a stated depth, within
which suffixes are then ordered; ties beyond it stand together, in any order.
"""

from __future__ import annotations

import numpy as np

from .vectext import eights

#: Modulus and a perfect difference set for it (fixed values: every residue is a difference of two of them).
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)

#: Suffixes of a bucket that are sorted at a time.
BUCKET_SUFFIXES = 1 << 20


def shifts(modulus: int = MODULUS, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """[a, b] to the least shift that puts positions of residues a and b both into the cover."""
    inside = np.zeros(2 * modulus, bool)
    inside[list(cover)] = True
    inside[modulus:] = inside[:modulus]
    table = np.full((modulus, modulus), -1, np.int64)
    for shift in range(modulus):
        ok = inside[shift : shift + modulus]
        both = ok[:, None] & ok[None, :] & (table < 0)
        table[both] = shift
    if (table < 0).any():
        raise ValueError("not a difference cover")
    return table


SHIFT = shifts()


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one big-endian number; zeros follow the end."""
    return eights(data)[: len(data)].byteswap()


def leading_keys(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The first MODULUS bytes from each position on, as comparable numbers (the last overlaps)."""
    n = len(words)
    keys = []
    for off in (0, 8, 16, MODULUS - 8):
        place = at + off
        keys.append(np.where(place < n, words[np.minimum(place, n - 1)], np.uint64(0)))
    return keys


def begins(sorted_keys: np.ndarray) -> np.ndarray:
    """Whether each of sorted keys differs from the one before it."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return new


def ordered(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of tuples of keys, and whether each differs from the one before it.

    By the first key, then by each further one only what is still tied, as one
    number of its group and its key's rank: plain sorts of single numbers.
    """
    order = np.argsort(keys[0])
    new = begins(keys[0][order])
    for key in keys[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        members = order[at]
        values = key[members]
        by_value = np.argsort(values)
        rank = np.empty(len(at), np.uint64)
        rank[by_value] = np.cumsum(begins(values[by_value]))
        both = np.cumsum(new)[at].astype(np.uint64) << np.uint64(32) | rank
        moved = np.argsort(both)
        order[at] = members[moved]
        new[at] = begins(both[moved])
    return order, new


def dense_ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks from 1 of tuples of keys, equal tuples ranking equal."""
    order, new = ordered(keys)
    ranks = np.empty(len(order), np.int32)
    ranks[order] = np.cumsum(new)
    return ranks


def sample_ranks(words: np.ndarray, depth: int | None = None) -> np.ndarray:
    """For every position, the rank among the samples (0 where it is no sample, or past the end) of its first ``depth`` bytes or more, by default of its suffix."""
    n = len(words)
    residue = np.zeros(MODULUS, bool)
    residue[list(COVER)] = True
    at = np.flatnonzero(residue[np.arange(n) % MODULUS])
    ranks = np.zeros(n + 2 * MODULUS, np.int32)
    if len(at):
        ranks[at] = dense_ranks(leading_keys(words, at))
        settled = MODULUS
        while settled < (n if depth is None else depth) and int(ranks[at].max()) < len(at):
            ranks[at] = dense_ranks([ranks[at], ranks[np.minimum(at + settled, n)]])
            settled *= 2
    return ranks


def buckets(words: np.ndarray, at: np.ndarray, most: int) -> list[np.ndarray]:
    """The positions dealt by their leading two bytes into buckets of about ``most``, in order."""
    lead = (words[at] >> np.uint64(48)).astype(np.int64)
    counts = np.bincount(lead, minlength=1 << 16)
    bucket = np.cumsum(counts) // max(1, most)
    bucket = bucket - bucket[0]
    of = bucket[lead]
    order = np.argsort(of, kind="stable")
    return np.split(at[order], np.flatnonzero(np.diff(of[order])) + 1)


def sort_bucket(words: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of one bucket in the order of their suffixes."""
    order, new = ordered(leading_keys(words, at))
    at, tied = at[order], ~new
    group = np.cumsum(new)
    # groups of equal leading bytes, split in three about a pivot until nothing moves
    active = np.flatnonzero(tied | np.append(tied[1:], False))
    while len(active):
        own, label = at[active], group[active]
        begin = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
        size = np.diff(np.append(begin, len(active)))
        pivot = np.repeat(own[begin + size // 2], size)
        shift = SHIFT[own % MODULUS, pivot % MODULUS]
        side = np.sign(ranks[own + shift].astype(np.int64) - ranks[pivot + shift])
        nth = np.repeat(np.arange(len(begin)), size)
        part = nth * 3 + side + 1
        moved = np.argsort(part, kind="stable")
        at[active] = own[moved]
        part, side = part[moved], side[moved]
        # members equal to the pivot are settled; smaller and greater ones of more than one go on
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        count = np.repeat(np.diff(np.append(cut, len(part))), np.diff(np.append(cut, len(part))))
        again = (side != 0) & (count > 1)
        fresh = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(part))))
        group[active] = fresh
        active = active[again]
    return at


def sorted_suffixes(data: np.ndarray, at: np.ndarray | None = None, most: int = BUCKET_SUFFIXES, depth: int | None = None):
    """Arrays of positions, bucket after bucket, in the order of the suffixes of ``data`` that begin there.

    Suffixes compare as if zeros followed their end, which those that end in zeros share.
    """
    if at is None:
        at = np.arange(len(data))
    if not len(at):
        return
    words = words_at(data)
    ranks = sample_ranks(words, depth)
    for bucket in buckets(words, at, most):
        yield sort_bucket(words, ranks, bucket)


def equal_to_previous(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` bytes from each position on equal those of the position before it in the list (width at least 8)."""
    same = np.zeros(len(at), bool)
    if len(at) > 1:
        a, b = at[1:], at[:-1]
        ok = np.ones(len(a), bool)
        for off in [*range(0, width - 8, 8), width - 8]:
            ok &= words[a + off] == words[b + off]
        same[1:] = ok
    return same


def window_classes(data: np.ndarray, at: np.ndarray, width: int, most: int = BUCKET_SUFFIXES) -> np.ndarray:
    """Class of the ``width`` bytes from each given position on (they must lie inside); equal strings share a class.

    Equal strings are neighbours in the suffix order to a depth of ``width``.
    """
    if width < 8:
        raise ValueError("strings of fewer than 8 bytes")
    classes = np.zeros(len(data), np.int64)
    words, last = words_at(data), 0
    ranks = sample_ranks(words, width)
    for bucket in buckets(words, at, most):
        order = sort_bucket(words, ranks, bucket)
        classes[order] = last + np.cumsum(~equal_to_previous(words, order, width))
        last = int(classes[order[-1]])
    return classes[at]
