"""Substring removal by Rabin-Karp hashes of every window of consecutive words.

Every window's hash is counted over the corpus (pass 1 of ``exchange``). The
windows that occur in two documents or more are compared by a second hash
beside the first, which gives each its smallest doc_id; a document then loses
the words covered by windows that start in a document with a smaller doc_id.
Covered words merge into maximal removal intervals.

Both are polynomials modulo 2**61 - 1 over hashed words, with bases and seeds
drawn anew for each call, so windows are one only if some 90 bits agree that
no text can be made to match.

Defined cases: a null text has no words; a text shorter than a window loses
nothing; rows of one doc_id never take from each other; a null doc_id takes
part in nothing and keeps its text; windows are judged on the input; an empty
table gives no rows. Memory follows a group (some megabytes) or the longest text.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import sha256_hex, text_rows
from .exchange import ANSWER, NO_ID, SENT, Group, answered, bucket_key, by_bucket, compressed, found_keys, lookup, pack, plan_groups, repeated, restored, sent, together, trimmed
from .vectext import PRIME, Texts, merge_spans, mix, owner, rolling, window_starts, word_hashes, words

WIDTH = 50
SLICE = (1 << 20) - 64

DIGESTS = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_intervals int"


@dataclass(frozen=True)
class Naming:
    """Seed of the hash of a word and base of the polynomial over a window."""

    seed: int
    base: int


def drawn() -> Naming:
    return Naming(secrets.randbits(64), 2 + secrets.randbelow(PRIME - 3))


def windows(texts: Texts, width: int, naming: Naming, found=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every window, the word where it starts and the text that holds it."""
    found = found or words(texts)
    hashes = rolling(word_hashes(texts, found, naming.seed), width, naming.base)
    start = np.flatnonzero(window_starts(found.first, width, len(found)))
    return mix(hashes[start]), start, owner(found.first, start)


def second_hashes(texts: Texts, found, start: np.ndarray, width: int, naming: Naming) -> np.ndarray:
    """The other hash of the windows that start at the given words."""
    return rolling(word_hashes(texts, found, naming.seed), width, naming.base)[start] if len(start) else np.zeros(0, np.uint64)


def group_windows(group: Group, width: int, naming: Naming) -> tuple[np.ndarray, np.ndarray]:
    """Hash and doc_id of every window of documents that have an identifier."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, part in group.texts.slices(SLICE):
        h, _, doc = windows(part, width, naming)
        ids = group.ids[at + doc]
        hashes.append(h[ids != NO_ID])
        owners.append(ids[ids != NO_ID])
    return np.concatenate(hashes), np.concatenate(owners)


def candidates(group: Group, width: int, answers: tuple[np.ndarray, np.ndarray], n_buckets: int, naming: tuple[Naming, Naming]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket key, second hash, doc_id) of the windows whose fingerprint is repeated, in the order of their words."""
    keys, seconds, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    known, _ = answers
    for at, part in group.texts.slices(SLICE):
        found = words(part)
        h, start, doc = windows(part, width, naming[0], found)
        key = bucket_key(h, n_buckets)
        ids = group.ids[at + doc]
        hit = np.flatnonzero((lookup(known, key) >= 0) & (ids != NO_ID))
        keys.append(key[hit])
        seconds.append(second_hashes(part, found, start[hit], width, naming[1]))
        owners.append(ids[hit])
    return np.concatenate(keys), np.concatenate(seconds), np.concatenate(owners)


def distinct_pairs(keys: np.ndarray, seconds: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (key, second) with the least owner of each."""
    order = np.lexsort((seconds, keys))
    k, s, o = keys[order], seconds[order], owners[order]
    at = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[at], s[at], np.minimum.reduceat(o, at) if len(at) else o


def send_evidence(group: Group, answers: pa.Table, g: int, width: int, n_buckets: int, naming: tuple[Naming, Naming]) -> pa.Table:
    key, second, least = distinct_pairs(*candidates(group, width, found_keys(answers), n_buckets, naming))
    return sent([(b, g, compressed((key[run] & np.uint64(0xFFFFFFFF)).astype("<u4"), second[run], least[run])) for b, run in by_bucket(key)])


def least_owners(table: pa.Table) -> pa.Table:
    """A bucket: where another group has a smaller doc_id for a key, that doc_id."""
    groups, bucket = table["g"].to_pylist(), table["b"][0].as_py()
    parts = [restored(d, "<u4", "<u8", "<i8") for d in table["data"].to_pylist()]
    low, second, own = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((low, second))
    at = np.flatnonzero(np.append(True, (second[order][1:] != second[order][:-1]) | (low[order][1:] != low[order][:-1])))
    least = np.empty(len(own), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(own[order], at), np.diff(np.append(at, len(own))))
    rows, begin = [], 0
    for g, part in zip(groups, parts, strict=True):
        end = begin + len(part[0])
        less = least[begin:end] < part[2]
        if less.any():
            rows.append((g, bucket, compressed(part[0][less], part[1][less], least[begin:end][less])))
        begin = end
    return answered(rows)


def removal_mask(group: Group, answers: pa.Table, width: int, n_buckets: int, naming: tuple[Naming, Naming]):
    """For each slice of the group: its texts, words, and which words go.

    Only windows are looked up that another document of the group or an answer holds.
    """
    keys, seconds, least = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b, data in sorted(zip(answers["b"].to_pylist(), answers["data"].to_pylist(), strict=True)):
        low, second, owners = restored(data, "<u4", "<u8", "<i8")
        keys.append(np.uint64(b) << np.uint64(32) | low.astype(np.uint64))
        seconds.append(second)
        least.append(owners)
    slices, own_keys, own_seconds, own_ids = [], [], [], []
    for at, part in group.texts.slices(SLICE):
        found = words(part)
        h, start, doc = windows(part, width, naming[0], found)
        slices.append((at, part, found, start))
        own_keys.append(bucket_key(h, n_buckets))
        own_seconds.append(second_hashes(part, found, start, width, naming[1]))
        own_ids.append(group.ids[at + doc])
    # the least owner of each window, among the group's own documents and the answers
    every_key = np.concatenate([*keys, *own_keys])
    every_second = np.concatenate([*seconds, *own_seconds])
    ids = np.concatenate([np.zeros(0, np.int64), *own_ids])
    every_owner = np.concatenate([*least, np.where(ids == NO_ID, np.iinfo(np.int64).max, ids)])
    order = np.lexsort((every_second, every_key))
    k, s = every_key[order], every_second[order]
    smallest = np.empty(len(order), np.int64)
    if len(order):
        at = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])))
        smallest[order] = np.repeat(np.minimum.reduceat(every_owner[order], at), np.diff(np.append(at, len(order))))
    gone = (smallest[len(every_key) - len(ids) :] < ids) & (ids != NO_ID)
    begin = 0
    for at, part, found, start in slices:
        hit = start[gone[begin : begin + len(start)]]
        begin += len(start)
        covered = np.zeros(len(found) + 1, np.int64)
        a, z = merge_spans(hit, width)
        # windows lie inside one text, but runs of two texts may touch
        covered[:-1] += np.bincount(a, minlength=len(found))[: len(found)]
        np.subtract.at(covered, z, 1)
        yield at, part, found, np.cumsum(covered[:-1]) > 0


def kept_bytes(part: Texts, found, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of all texts, each followed by a space, and where each text's begin (one entry more)."""
    keep = np.flatnonzero(~gone)
    size = found.end[keep] - found.start[keep] + 1
    upto = np.append(0, np.cumsum(size))
    data = np.append(part.data, np.uint8(32))
    at = np.arange(upto[-1]) + np.repeat(found.start[keep] - upto[:-1], size)
    out = data[np.minimum(at, len(data) - 1)]
    out[upto[1:] - 1] = 32
    return out, upto[np.searchsorted(keep, found.first)]


def outcomes(group: Group, answers: pa.Table, width: int, n_buckets: int, naming: tuple[Naming, Naming], with_text: bool = False) -> pa.Table:
    columns: list[list] = [[], [], [], [], []]
    for _, part, found, gone in removal_mask(group, answers, width, n_buckets, naming):
        data, bounds = kept_bytes(part, found, gone)
        view = memoryview(data)
        edge = np.ones(len(gone), bool)
        edge[1:] = ~gone[:-1]
        edge[found.first[:-1][found.first[:-1] < len(gone)]] = True
        runs = np.append(0, np.cumsum(gone & edge))
        lost = np.append(0, np.cumsum(gone))
        columns[0] += np.diff(found.first).tolist()
        columns[1] += (lost[found.first[1:]] - lost[found.first[:-1]]).tolist()
        columns[3] += (runs[found.first[1:]] - runs[found.first[:-1]]).tolist()
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            columns[2].append(sha256_hex(view[a : max(a, z - 1)]))
            if with_text:
                columns[4].append(bytes(view[a : max(a, z - 1)]).decode("utf-8"))
    arrays = [group.id_column(), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32())]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_intervals"]
    if with_text:
        arrays.append(pa.array(columns[4], pa.string()))
        names.append("kept_text")
    return pa.Table.from_arrays(arrays, names)


def remove_repeated_windows(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: its words, how many go, and a digest (``with_text``: also the text) of what stays."""
    rows = text_rows(docs, id_col, text_col)
    n, naming = plan_groups(rows), (drawn(), drawn())
    packed = pack(rows, n)
    hits = repeated(packed, lambda group: group_windows(group, width, naming[0]), n)
    evidence = together(packed, hits, lambda group, answers, g: send_evidence(group, answers, g, width, n, naming), SENT)
    settled = evidence.groupBy("b").applyInArrow(trimmed(least_owners), ANSWER)
    return together(packed, settled, lambda group, answers, g: outcomes(group, answers, width, n, naming, with_text), DIGESTS + (", kept_text string" if with_text else ""))
