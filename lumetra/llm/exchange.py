"""Exact repetition search over a whole corpus in three passes of bounded exchanges.

Documents are dealt by hash into groups of a few megabytes, compressed, and
shuffled once; that exchange is read again by each pass:

1. *Signals.* A group names what it holds by 64-bit hashes and sends, for each
   hash bucket, the sorted distinct fingerprints (the bucket and 32 bits) with
   a count. The bucket answers each group with those seen in two documents or
   more. False alarms of 32 bits only cost work in pass 2.
2. *Evidence.* For what is repeated, a group sends distinct keys with its
   smallest doc_id for each; the bucket compares keys exactly and answers with
   the smallest doc_id of all where it is smaller.
3. *Outcome.* The group applies the answers to its own documents.

Groups aggregate before they send, so however often something occurs a bucket
receives it once a group: no key, however hot, gathers in one task. Groups and
buckets grow in number with the input, and in size with its square root once
messages would get short (``plan_groups``): there is at most one message, a row
for a (group, bucket), for every ``MESSAGE_BYTES`` of text.

Documents without an identifier neither remove nor lose anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column, release, shuffle_partitions
from .vectext import Texts

GROUP_BYTES = 4 << 20
MESSAGE_BYTES = 2 << 10
PACK_BYTES = 8 << 20
#: Least id: stands for null inside a group, and is never the owner of anything.
NO_ID = -(2**63)

PACKED = "g int, blob binary"
SENT = "b int, g int, data binary"
ANSWER = "g int, b int, data binary"


def compressed(*arrays: np.ndarray) -> bytes:
    """Arrays end to end, with their lengths, as one zstd frame."""
    parts = [np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def restored(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8).tolist()
    at, out = 8 * (n + 1), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def row_key(doc_id, text):
    return F.xxhash64(doc_id, text)


def plan_groups(rows: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    """Number of groups for the text there is, as many as the session has shuffle partitions unless these are too many."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return group_count(total, shuffle_partitions(rows.sparkSession), group_bytes)


def group_count(total: int, partitions: int, group_bytes: int = GROUP_BYTES) -> int:
    """Groups for so many bytes of text.

    With n groups and as many buckets there are up to n * n messages: n is at
    most sqrt(total / MESSAGE_BYTES), which keeps them at total / MESSAGE_BYTES.
    """
    most = isqrt(total // MESSAGE_BYTES)
    return max(1, min(most, max(partitions, -(-total // group_bytes))))


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def pack(rows: DataFrame, n_groups: int) -> DataFrame:
    """Rows (doc_id, text) as compressed blocks by group, hash-partitioned by ``g``; null texts are empty.

    Each row carries ``row_key``, which is the same for rows equal in both columns alone.
    """
    keyed = rows.select(row_key("doc_id", "text").alias("key"), "doc_id", "text")
    dealt = keyed.select(F.pmod("key", F.lit(n_groups)).cast("int").alias("g"), "key", "doc_id", "text")

    def run(batches):
        for table in gathered(batches, PACK_BYTES):
            texts = Texts.of_arrow(table["text"])
            g, row_keys = table["g"].to_numpy(), table["key"].to_numpy()
            ids, sizes = table["doc_id"].fill_null(NO_ID).to_numpy(), texts.sizes()
            order = np.argsort(g, kind="stable")
            keys, blobs = [], []
            for some in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
                keys.append(int(g[some[0]]))
                text = np.frombuffer(b"".join([texts.text(i) for i in some]), np.uint8)
                blobs.append(compressed(ids[some], row_keys[some], sizes[some], text))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["g", "blob"])
        release()

    return dealt.mapInArrow(run, PACKED).repartition(n_groups, "g")


class Group:
    """Documents of a group in an order that does not depend on how they arrived."""

    def __init__(self, packed: pa.Table):
        ids, keys, sizes, data = [], [], [], []
        for blob in packed["blob"].to_pylist():
            i, k, s, d = restored(blob, "<i8", "<i8", "<i8", "u1")
            ids.append(i)
            keys.append(k)
            sizes.append(s)
            data.append(d)
        none = np.zeros(0, np.int64)
        ids, keys, sizes = (np.concatenate([*x, none]) for x in (ids, keys, sizes))
        texts = Texts(np.concatenate([*data, np.zeros(0, np.uint8)]), np.append(0, np.cumsum(sizes)))
        order = np.lexsort((keys, sizes, ids))
        bounds = np.append(0, np.cumsum(sizes[order]))
        data = np.empty(len(texts.data), np.uint8)
        for to, i in enumerate(order.tolist()):
            data[bounds[to] : bounds[to + 1]] = texts.data[texts.bounds[i] : texts.bounds[i + 1]]
        self.ids, self.keys = ids[order], keys[order]
        self.texts = Texts(data, bounds)

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, mask=self.ids == NO_ID)


def bucket_key(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket in the high and fingerprint in the low 32 bits."""
    return ((hashes >> np.uint64(32)) % np.uint64(n_buckets)) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def by_bucket(keys: np.ndarray):
    """(bucket, slice) of runs of sorted bucket keys."""
    if not len(keys):
        return
    buckets = (keys >> np.uint64(32)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(buckets[a]), slice(a, b)


def distinct_owners(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys with how many owners each has at least (2 if more), its least owner, and its occurrences."""
    order = np.argsort(keys)
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return k, np.zeros(0, np.int64), o, np.zeros(0, np.int64)
    least, most = np.minimum.reduceat(o, at), np.maximum.reduceat(o, at)
    return k[at], 1 + (least != most), least, np.diff(np.append(at, len(k)))


def sent(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, g, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.Table.from_arrays([pa.array(b, pa.int32()), pa.array(g, pa.int32()), pa.array(data, pa.binary())], ["b", "g", "data"])


def answered(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    g, b, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.Table.from_arrays([pa.array(g, pa.int32()), pa.array(b, pa.int32()), pa.array(data, pa.binary())], ["g", "b", "data"])


def trimmed(work: Callable) -> Callable:
    """``work`` on a group, after which the worker gives back what it has freed.

    Spark looks at the number of arguments, and plans show the name.
    """
    if work.__code__.co_argcount == 1:

        def one(table):
            out = work(table)
            release()
            return out

        one.__name__ = work.__name__
        return one

    def two(left, right):
        out = work(left, right)
        release()
        return out

    two.__name__ = work.__name__
    return two


def repeated(packed: DataFrame, signals: Callable[..., tuple[np.ndarray, np.ndarray]], n_buckets: int, side: DataFrame | None = None) -> DataFrame:
    """Pass 1: for each group and bucket, the repeated fingerprints and how often each occurs (capped at a group's 255).

    ``signals`` gives hashes and the doc_id that holds each, of a group and,
    where there is one, its rows of ``side`` (g, b, data).
    """

    def emit(table: pa.Table, *more: pa.Table) -> pa.Table:
        if not table.num_rows:
            return sent([])
        hashes, owner = signals(Group(table), *more)
        keys, owners, _, times = distinct_owners(bucket_key(hashes, n_buckets), owner)
        times = np.minimum(np.maximum(times, 1), 255).astype(np.uint8)
        times[owners < 2] = 1  # in one document only: counts once
        g = table["g"][0].as_py()
        return sent([(b, g, b"".join([(keys[run] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), times[run].tobytes()])) for b, run in by_bucket(keys)])

    def reduce(table: pa.Table) -> pa.Table:
        groups, bucket = table["g"].to_pylist(), table["b"][0].as_py()
        blobs = table["data"].to_pylist()
        lows = [np.frombuffer(d, "<u4", len(d) // 5) for d in blobs]
        times = [np.frombuffer(d, "u1", len(d) // 5, len(d) // 5 * 4) for d in blobs]
        everything = np.concatenate(lows)
        order = np.argsort(everything)
        values = everything[order]
        at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        total = np.add.reduceat(np.concatenate(times)[order].astype(np.int64), at)
        often = total > 1
        values, total = values[at][often], total[often]
        rows = []
        for g, own in zip(groups, lows, strict=True):
            place = np.searchsorted(values, own)
            place[place == len(values)] = 0
            hit = values[place] == own if len(values) else np.zeros(len(own), bool)
            if hit.any():
                rows.append((g, bucket, compressed(own[hit], np.minimum(total[place[hit]], 2**32 - 1).astype("<u4"))))
        return answered(rows)

    if side is None:
        evidence = packed.groupBy("g").applyInArrow(trimmed(lambda table: emit(table)), SENT)
    else:
        evidence = packed.groupBy("g").cogroup(side.groupBy("g")).applyInArrow(trimmed(lambda table, more: emit(table, more)), SENT)
    return evidence.groupBy("b").applyInArrow(trimmed(reduce), ANSWER)


def found_keys(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted bucket keys and counts out of a group's answers of pass 1."""
    keys, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for b, data in sorted(zip(answers["b"].to_pylist(), answers["data"].to_pylist(), strict=True)):
        low, count = restored(data, "<u4", "<u4")
        keys.append(np.uint64(b) << np.uint64(32) | low.astype(np.uint64))
        times.append(count)
    return np.concatenate(keys), np.concatenate(times)


def lookup(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key, or -1."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, at, -1)


def together(packed: DataFrame, answers: DataFrame, work: Callable[[Group, pa.Table, int], pa.Table], schema: str) -> DataFrame:
    """Each group with its answers (none if there were none)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], _arrow(schema))
        return work(Group(left), right, left["g"][0].as_py())

    return packed.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(trimmed(run), schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])
