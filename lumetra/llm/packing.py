"""Best-two-fit packing of documents into fixed-length training sequences.

Token lengths are at most the capacity, so the whole packing problem is a
histogram of at most ``capacity`` counts, whatever the corpus. The plan is made
on the histogram: a bin is filled greedily with the largest documents that
fit, then its smallest document gives way to the two unpacked ones that fill
the widened gap best, if they fill it better. The bin found is repeated while
all its lengths last, so a plan has few patterns however many bins it stands
for. Pieces then take their places by their rank within their length.

Defined cases: a null or empty text is the end token alone; repeated rows are
separate documents; equal lengths are interchangeable (ties go by partition
and position); an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import checkpointed, column, map_texts, shipped, text_rows
from .bpe import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_pair(active: list[int], left: dict[int, int], room: int) -> tuple[int, int]:
    """The two unpacked lengths of largest sum within ``room`` ((0, 0) if none); ties take the larger first item."""
    best, pair = 0, (0, 0)
    low, high = 0, bisect_right(active, room - 1) - 1
    while low <= high:
        total = active[low] + active[high]
        if total > room or low == high and left[active[low]] < 2:
            high -= 1
            continue
        if total > best:
            best, pair = total, (active[high], active[low])
            if best == room:
                break
        low += 1
    return pair


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many such bins) from how many pieces there are of each length."""
    left = {n: c for n, c in counts.items() if c}
    if left and not (1 <= min(left) and max(left) <= capacity):
        raise ValueError("lengths lie outside 1 to the capacity")
    active, patterns = sorted(left), []

    def take(n: int) -> None:
        left[n] -= 1
        if not left[n]:
            del left[n]
            active.remove(n)

    def put_back(n: int) -> None:
        if n not in left:
            left[n] = 0
            active.insert(bisect_right(active, n), n)
        left[n] += 1

    while active:
        held, gap = [], capacity
        while gap and (i := bisect_right(active, gap)):
            held.append(active[i - 1])
            gap -= held[-1]
            take(held[-1])
        if gap and len(held) > 1:
            small = held[-1]  # greedy filling takes the largest first
            a, b = best_pair(active, left, gap + small)
            if a + b > small:
                take(a)
                take(b)
                put_back(held.pop())
                held = sorted([*held, a, b], reverse=True)
        need: dict[int, int] = {}
        for n in held:
            need[n] = need.get(n, 0) + 1
        more = min(left.get(n, 0) // k for n, k in need.items())
        patterns.append((tuple(held), 1 + more))
        if more:
            for n, k in need.items():
                left[n] -= more * k
                if not left[n]:
                    del left[n]
                    active.remove(n)
    return patterns


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each run of places."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for held, times in patterns:
        offset = 0
        for n in held:
            runs.setdefault(n, []).append((filled.get(n, 0), sequence, offset))
            filled[n] = filled.get(n, 0) + times
            offset += n
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}


def piece_rows(doc_ids, ids: np.ndarray, bounds: np.ndarray, end_id: int, capacity: int, with_ids: bool = False) -> pa.RecordBatch:
    """Rows of the pieces of encoded documents, each ended by ``end_id``; the first piece of a long one may be shorter."""
    n = len(bounds) - 1
    sizes = np.diff(bounds) + 1
    flat = np.full(int(sizes.sum()), end_id, "<u4")
    begin = np.cumsum(sizes) - sizes
    flat[np.arange(len(ids)) + np.repeat(np.arange(n), sizes - 1)] = ids
    k = -(-sizes // capacity)
    first = sizes - (k - 1) * capacity
    doc = np.repeat(np.arange(n), k)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    start = np.where(piece, first[doc] + (piece - 1) * capacity, 0)
    length = np.where(piece, capacity, first[doc])
    raw = memoryview(flat).cast("B")
    at = ((begin[doc] + start) * 4).tolist()
    to = ((begin[doc] + start + length) * 4).tolist()
    crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, to, strict=True)]
    arrays = [doc_ids.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        arrays.append(pa.array([bytes(raw[a:b]) for a, b in zip(at, to, strict=True)], pa.binary()))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)


def pieces_of(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    shipped(docs.sparkSession, vocabulary)

    def work(batch, texts):
        ids, bounds = encoder(vocabulary, pattern).encode(texts)
        return piece_rows(column(batch, "doc_id"), ids, bounds, end_id, capacity, with_ids)

    return map_texts(text_rows(docs, id_col, text_col), work, PIECES + (", ids binary" if with_ids else ""))


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length``; ``pieces`` is computed once, into the checkpoint."""
    pieces = checkpointed(pieces.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()))
    per_part = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = per_part.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # at most ``capacity`` rows come to the driver
    counts = {int(r["length"]): int(r["n"]) for r in per_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    taken = places(plan(counts, capacity))
    nth = F.row_number().over(W.partitionBy("_part", "length").orderBy("_pos")).cast("long") - 1
    ranked = pieces.withColumn("_nth", nth).join(bases, ["_part", "length"]).withColumn("_rank", F.col("_base") + F.col("_nth"))
    kept = [c for c in pieces.columns if c not in ("_part", "_pos")]
    fields = [f for f in pieces.schema.fields if f.name in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = column(batch, "length").to_numpy(), column(batch, "_rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, base, at = taken[int(n)]
                run = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows] = base[run] + rank[rows] - first[run]
                offset[rows] = at[run]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "_rank").mapInArrow(assign, schema)


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: where its tokens lie in its document and in its sequence."""
    return place_pieces(pieces_of(docs, vocabulary, pattern, end_id, capacity, id_col, text_col, with_ids), capacity)
