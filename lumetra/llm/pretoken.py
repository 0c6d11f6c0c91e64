"""Vectorised pre-tokenisation, equal to scanning with the public split pattern.

The pattern is: contractions | ' ?letters' | ' ?numbers' | ' ?others' |
white space not followed by non-white-space | white space. Its matches follow
from runs of four character classes:

* every class change begins a piece;
* of white space before something else, the last character stands apart; if
  that character is U+0020 it begins the following piece instead;
* a lone apostrophe that no U+0020 precedes begins a contraction if the
  letters after it allow.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from .vectext import Texts

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

# Code points of the Unicode property White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point, from the general categories of this Python's Unicode tables."""
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE_SPACE] = SPACE
        _classes = table
    return _classes


def code_points(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of valid UTF-8, the byte where each begins (with the end appended), and the first of each text."""
    lead = (texts.data & 0xC0) != 0x80
    at = np.append(np.flatnonzero(lead), len(texts.data))
    points = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, at, np.searchsorted(at, texts.bounds)


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of the character that begins each piece, texts being separated at ``first``."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    begin = np.zeros(n + 1, bool)  # of a text
    begin[first] = True
    starts = np.zeros(n + 1, bool)
    starts[1:n] = kind[1:] != kind[:-1]
    starts |= begin
    # where a run of white space ends because something else follows in the same text
    ends = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begin[1:n]) if n > 1 else np.zeros(0, np.int64)
    starts[ends] = True
    joined = ends[points[ends] == 0x20] + 1
    starts[joined] = False
    # contractions: an apostrophe that begins a piece of its own
    quote = np.flatnonzero((points == 0x27) & starts[:n])
    if len(quote):
        ahead = np.append(points, [0, 0])
        text_end = first[np.searchsorted(first, quote, side="right")]
        one = np.where(quote + 1 < text_end, ahead[quote + 1], 0)
        two = np.where(quote + 2 < text_end, ahead[np.minimum(quote + 2, n)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for pair in ("re", "ve", "ll"):
            size = np.where((one == ord(pair[0])) & (two == ord(pair[1])), 3, size)
        hit = size > 0
        starts[quote[hit] + 1] = False
        starts[quote[hit] + size[hit]] = True
    return np.flatnonzero(starts[:n])


def pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every piece, and the first piece of each text (one entry more)."""
    points, at, first = code_points(texts)
    starts = piece_starts(points, first)
    ends = np.append(starts[1:], len(points)) if len(starts) else starts
    return at[starts], at[ends], np.searchsorted(starts, first)


#: Bytes before a chunk's end in which a boundary could still move: the pattern looks at most two characters ahead.
UNSURE_BYTES = 12


def chunk_bounds(texts: Texts, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of overlapping chunks that cover every text and begin and end between characters."""
    lengths = texts.sizes()
    n = np.maximum(1, -(-(lengths - overlap) // size))
    owner = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    low, high = texts.bounds[owner], texts.bounds[owner + 1]
    begin = low + nth * size
    end = np.where(nth == n[owner] - 1, high, begin + size + overlap)
    for at in (begin, end):
        for _ in range(3):
            inside = np.flatnonzero((at > low) & (at < high))
            at[inside] -= (texts.data[at[inside]] & 0xC0) == 0x80
    return begin, end, owner


def chunked_pieces(texts: Texts, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``pieces``, from overlapping chunks that are scanned side by side.

    Where two neighbours first have a common boundary in their overlap they are
    stitched: a match depends on what follows it alone, so from there on both
    scans are the text's. A text in which some overlap has no common boundary
    (a run of one kind of characters longer than it) is scanned as a whole.
    """
    begin, end, owner = chunk_bounds(texts, size, overlap)
    if len(owner) == len(texts):
        return pieces(texts)  # each text is one chunk
    sizes = end - begin
    upto = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(sizes, out=upto[1:])
    chunks = Texts(texts.data[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], sizes)], upto)
    points, at, first = code_points(chunks)
    starts = at[piece_starts(points, first)]
    chunk = np.searchsorted(upto, starts, side="right") - 1
    place = starts - upto[chunk] + begin[chunk]
    # pairs of neighbours, named by the first
    more = np.append(owner[1:] == owner[:-1], False)
    after = np.minimum(np.arange(len(begin)) + 1, len(begin) - 1)
    met = lambda which, pair: which & (place > begin[after[pair]]) & (place <= end[pair] - UNSURE_BYTES)
    before = np.maximum(chunk - 1, 0)
    tail, head = met(more[chunk], chunk), met((chunk > 0) & more[before], before)
    common = np.intersect1d(chunk[tail] << 40 | place[tail], before[head] << 40 | place[head], assume_unique=True)
    pair, which = np.unique(common >> 40, return_index=True)
    meet = np.full(len(begin), -1)
    meet[pair] = common[which] & (1 << 40) - 1
    broken = np.zeros(len(texts), bool)
    broken[owner[more & (meet < 0)]] = True
    low = np.where(np.append(False, more[:-1]), np.roll(meet, 1), begin)
    high = np.where(more, meet, end)
    found = place[(place >= low[chunk]) & (place < high[chunk]) & ~broken[owner[chunk]]]
    if broken.any():
        again = np.flatnonzero(broken)
        lengths = texts.sizes()[again]
        to = np.zeros(len(again) + 1, np.int64)
        np.cumsum(lengths, out=to[1:])
        whole = Texts(texts.data[np.arange(to[-1]) + np.repeat(texts.bounds[again] - to[:-1], lengths)], to)
        starts, _, _ = pieces(whole)
        text = np.searchsorted(to, starts, side="right") - 1
        found = np.sort(np.concatenate([found, starts - to[text] + texts.bounds[again[text]]]))
    return found, np.append(found[1:], len(texts.data)) if len(found) else found, np.searchsorted(found, texts.bounds)
