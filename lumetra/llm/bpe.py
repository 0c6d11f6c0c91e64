"""Byte-level BPE over distinct pieces.

A block of texts is pre-tokenised, equal pieces are encoded once by the BPE
library, and identifiers are laid out again by array gathers. The cache of
pieces lives as long as the Python worker and is bounded (about 20 MB). A piece
of up to 7 bytes is its own key; a longer one is found by a hash and counts as
the piece that is kept only if all its bytes agree.

A ``.json`` vocabulary names added tokens; as in the tokenizers library, a text
is split where one of them stands, it has its own identifier, and the parts
between are encoded as texts of their own.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np
import tiktoken
from pyspark import SparkFiles

from .pretoken import pieces
from .vectext import FIRST_BYTES, SEED, Texts, eights, mix, same_spans, span_hashes

#: Distinct pieces, and their identifiers and bytes, that a worker keeps before it starts again.
CACHE_PIECES = 150_000
CACHE_IDS = 1_000_000
CACHE_BYTES = 4_000_000
#: Pieces of more bytes are encoded wherever they occur.
CACHED_BYTES = 64
#: Bits of the table that finds most pieces.
TABLE_BITS = 18


def ranks_of_lines(path: str) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def ranks_of_json(path: str) -> dict[bytes, int]:
    """Ranks from a byte-level vocabulary whose characters stand for bytes; special tokens have none."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = {t["content"] for t in held["added_tokens"]}
    return {bytes(byte_of[c] for c in token): rank for token, rank in held["model"]["vocab"].items() if token not in special}


def added_of_json(path: str) -> dict[bytes, int]:
    """Added tokens and their identifiers; those that take in spaces or heed words beside them are refused."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    if any(t.get(option) for t in held["added_tokens"] for option in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens with lstrip, rstrip or single_word")
    return {t["content"].encode("utf-8"): t["id"] for t in held["added_tokens"]}


class Growing:
    """An array that is appended to, in a buffer that doubles."""

    def __init__(self, kind, first=()):
        self.buffer, self.size = np.zeros(1 << 10, kind), 0
        self.extend(np.array(first, kind))

    def __len__(self) -> int:
        return self.size

    def view(self) -> np.ndarray:
        return self.buffer[: self.size]

    def extend(self, values: np.ndarray) -> None:
        while self.size + len(values) > len(self.buffer):
            self.buffer = np.concatenate([self.buffer, np.zeros_like(self.buffer)])
        self.buffer[self.size : self.size + len(values)] = values
        self.size += len(values)


class Encoder:
    """Texts to identifiers and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, added: dict[bytes, int] | None = None):
        self.added = added or {}
        # the longest of those that begin in one place
        self.added_at = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max([*ranks.values(), *self.added.values()]) + 1
        tokens: list[bytes] = [b""] * size
        for token, rank in [*ranks.items(), *self.added.items()]:
            tokens[rank] = token
        self.token_at = np.zeros(size + 1, np.int64)
        np.cumsum([len(t) for t in tokens], out=self.token_at[1:])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.ids = Growing(np.uint32)  # of all slots, end to end
        self.ids_at = Growing(np.int64, [0])
        self.bytes = Growing(np.uint8)
        self.bytes_at = Growing(np.int64, [0])
        self.table_key = np.zeros(1 << TABLE_BITS, np.uint64)
        self.table_slot = np.full(1 << TABLE_BITS, -1, np.int32)

    def _learn(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> int:
        """Encode pieces and give them slots in a row; the first slot."""
        first, encode = len(self.ids_at) - 1, self.library.encode_ordinary
        spans = list(zip(start.tolist(), end.tolist(), strict=True))
        found = [encode(raw[a:z].decode("utf-8")) for a, z in spans]
        self.ids_at.extend(self.ids_at.view()[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))
        self.ids.extend(np.fromiter((i for ids in found for i in ids), np.uint32))
        # bytes are compared for cached pieces alone
        kept = [raw[a:z] if z - a <= CACHED_BYTES else b"" for a, z in spans]
        self.bytes_at.extend(self.bytes_at.view()[-1] + np.cumsum(np.fromiter(map(len, kept), np.int64, len(kept))))
        self.bytes.extend(np.frombuffer(b"".join(kept), np.uint8))
        return first

    def _agree(self, at: np.ndarray, start: np.ndarray, size: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Whether pieces have the bytes of their slots; those of up to 7 bytes do by their keys."""
        same = np.ones(len(start), bool)
        long = np.flatnonzero((size > 7) & (slots >= 0))
        held = self.bytes_at.view()
        begin = held[slots[long]]
        same[long] = held[slots[long] + 1] - begin == size[long]
        some = long[same[long]]
        same[some] = same_spans(at, start[some], eights(self.bytes.view(), laid_out=False), held[slots[some]], size[some])
        return same

    def _slots(self, texts: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Slot of every piece: from the direct table, else the dictionary, else the library."""
        at, size = eights(texts.data), end - start
        keys = at[start] & FIRST_BYTES[np.minimum(size, 7)] | size.astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(size > 7)
        if len(long):
            keys[long] = span_hashes(texts.data, start[long], end[long], SEED, at) | np.uint64(0xFF << 56)
        place = (mix(keys) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        slots = np.where(self.table_key[place] == keys, self.table_slot[place], -1).astype(np.int64)
        rest = np.flatnonzero((slots < 0) & (size <= CACHED_BYTES))
        raw = b""
        if len(rest):
            distinct, where, back = np.unique(keys[rest], return_index=True, return_inverse=True)
            listed, where = distinct.tolist(), rest[where]
            get = self.slot.get
            found = np.fromiter((get(k, -1) for k in listed), np.int64, len(listed))
            fresh = np.flatnonzero(found < 0)
            if len(fresh):
                raw = texts.data.tobytes()
                first = self._learn(raw, start[where[fresh]], end[where[fresh]])
                found[fresh] = np.arange(first, first + len(fresh))
                self.slot.update(zip(distinct[fresh].tolist(), found[fresh].tolist(), strict=True))
            slots[rest] = found[back]
            # of several new keys in one place the last written holds both columns
            spot = place[where]
            self.table_key[spot] = distinct
            held = self.table_key[spot] == distinct
            self.table_slot[spot[held]] = found[held]
        # pieces that are not the ones kept under their key, and those too long to keep
        alone = np.flatnonzero((slots < 0) | ~self._agree(at, start, size, slots))
        if len(alone):
            first = self._learn(raw or texts.data.tobytes(), start[alone], end[alone])
            slots[alone] = np.arange(first, first + len(alone))
        return slots

    def encode(self, texts: Texts, split=pieces) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all texts end to end, and where each text's begin (one entry more); ``split`` finds the pieces."""
        raw = texts.data.tobytes() if self.added_at else b""
        if self.added_at and self.added_at.search(raw):
            edges = texts.bounds.tolist()
            spans = [m.span() for a, z in zip(edges, edges[1:], strict=False) for m in self.added_at.finditer(raw, a, z)]
            if spans:
                return self._encode_around(texts, np.array(spans, np.int64), np.array([self.added[raw[a:z]] for a, z in spans], np.uint32), split)
        start, end, first = split(texts)
        ids, upto = self.encode_spans(texts, start, end)
        return ids, upto[first]

    def _encode_around(self, texts: Texts, spans: np.ndarray, tokens: np.ndarray, split) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the added tokens that lie at ``spans``."""
        marks = np.sort(np.concatenate([texts.bounds, spans.ravel()]))
        # of parts that begin in one place, all but the last are empty
        part = np.searchsorted(marks, spans[:, 0], side="right") - 1
        start, end, first = split(Texts(texts.data, marks))
        ids, upto = self.encode_spans(texts, start, end)
        at = upto[first]
        ids[at[part]] = tokens
        # each of these parts keeps its first identifier alone
        step = np.zeros(len(ids) + 1, np.int64)
        np.add.at(step, at[part] + 1, 1)
        np.add.at(step, at[part + 1], -1)
        sizes = np.diff(at)
        sizes[part] = 1
        return ids[np.cumsum(step[:-1]) == 0], np.append(0, np.cumsum(sizes))[np.searchsorted(marks, texts.bounds)]

    def encode_spans(self, texts: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of given pieces end to end, and where each piece's begin (one entry more)."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(self.ids_at) > CACHE_PIECES or len(self.ids) > CACHE_IDS or len(self.bytes) > CACHE_BYTES:
            self.clear()
        slots = self._slots(texts, start, end)
        ids_at = self.ids_at.view()
        begin, sizes = ids_at[slots], ids_at[slots + 1] - ids_at[slots]
        upto = np.zeros(len(slots) + 1, np.int64)
        np.cumsum(sizes, out=upto[1:])
        return self.ids.view()[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], sizes)], upto

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> Texts:
        """Raw bytes of the tokens, end to end."""
        begin = self.token_at[ids]
        sizes = self.token_at[ids.astype(np.int64) + 1] - begin
        upto = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=upto[1:])
        return Texts(self.token_bytes[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], sizes)], upto[bounds])


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary file, made once; a file that is not there is one that Spark has brought."""
    if (path, pattern) not in _encoders:
        held = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        _encoders[path, pattern] = Encoder(ranks_of_json(held), pattern, added_of_json(held)) if path.endswith(".json") else Encoder(ranks_of_lines(held), pattern)
    return _encoders[path, pattern]
